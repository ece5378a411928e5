import json
import random

import pytest

from castline.operators import joins, logs
from castline.streaming import journal, pending
from tests.test_logs import LOG


def run_batches(stream, tmp_path, name, mode, batches, write):
    """All rows of a stream so far, after each batch that is written and worked off."""
    found = []
    for batch in batches:
        write(batch)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start()
        assert query.awaitTermination(120)
        yield list(found)


def test_records_of_any_cut_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"{show}/log_2024-05-01.log": LOG * 3 for show in ("a", "b")}
    lines = [(f, "2024-05-01", n, raw) for f, text in texts.items() for n, raw in enumerate(text.split("\n"), 1)]
    schema = "file string, log_date string, line_no int, raw string"
    want = sorted(tuple(r) for r in logs.production_records(spark.createDataFrame(lines, schema)).select("file", "log_date", "run_index", "log_line", "seq", "speaker", "backend", "char_count", "stem_path", "sha256").collect())
    assert len(want) == 12
    folder = tmp_path / "lines"
    folder.mkdir()
    stream = spark.readStream.schema(schema).json(str(folder))
    cuts = sorted(rng.sample(range(1, len(LOG.split("\n")) * 3), 3))
    parts = [[line for line in lines if a < line[2] <= b] for a, b in zip([0, *cuts], [*cuts, 10**6])]

    def write(part):
        rows = list(part)
        rng.shuffle(rows)
        name = f"{len(list(folder.iterdir())):03d}.json"
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("file", "log_date", "line_no", "raw"), r))) for r in rows))
        (tmp_path / name).rename(folder / name)

    *_, last = run_batches(journal.assembled_records(stream), tmp_path, "cut", "append", parts, write)
    assert sorted(r[:10] for r in last) == want and all(r[10] for r in last)


def test_incomplete_records_time_out(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    stream = spark.readStream.schema("file string, log_date string, line_no int, raw string").json(str(folder))
    found = []
    query = journal.assembled_records(stream, 0.2).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").foreachBatch(lambda df, n: found.extend(df.collect())).start()
    try:
        rows = [{"file": "a", "log_date": "2024-05-01", "line_no": i, "raw": raw} for i, raw in enumerate(LOG.split("\n")[1:3])]
        (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
        for _ in range(100):
            query.awaitTermination(0.5)
            if found:
                break
    finally:
        query.stop()
    assert [(r.file, r.seq, r.stem_filename, r.sha256, r.complete) for r in found] == [("a", 7, "007_a.mp3", None, False)]


def test_logs_and_edits_are_told_by_their_paths(spark, tmp_path):
    for show in ("a", "b"):
        (tmp_path / "logs" / show).mkdir(parents=True)
        (tmp_path / "logs" / show / "x.log").write_text("2024-05-01T10:00:00Z|BEGIN\n2024-05-01T10:00:01Z|go\n")
        (tmp_path / "edits" / show).mkdir(parents=True)
        (tmp_path / "edits" / show / "x.jsonl").write_text(json.dumps({"ts": "1", "key": "K", "fields": {"volume_percentage": show}}) + "\n")
    for stream, mode in ((journal.numbered_runs(journal.log_runs(spark, str(tmp_path / "logs"), r"\|BEGIN\b")), "append"), (journal.replay_stream(journal.edits(spark, str(tmp_path / "edits"))), "update")):
        query = stream.writeStream.format("memory").queryName(f"told_{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(r.run for r in spark.table("told_append").collect()) == [1, 1, 1, 1]
    assert sorted((r.file.split("/")[-2], r.value, r.edits) for r in spark.table("told_update").collect()) == [("a", "a", 1), ("b", "b", 1)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_pending_with_a_time_to_live(spark, tmp_path, rocks):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("a", 9, "2024-05-02", "edited"), ("a", 9, "2024-05-01", "produced"), ("a", 8, "2024-05-01", "edited")]
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("file", "seq", "at", "side"), r))) for r in rows))
    stream, found = spark.readStream.schema("file string, seq long, at string, side string").json(str(folder)), []
    changes = pending.pending_stream(stream.where("side = 'edited'"), stream.where("side = 'produced'"), ["file"], keep_days=30)
    # With a time to live there is always a next batch, so the query is stopped when its rows are there.
    query = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start()
    for _ in range(60):
        if found or query.awaitTermination(1):
            break
    query.stop()
    assert found == [("a", 9, "2024-05-02", "2024-05-01", True)]


def test_pending_equals_the_batch_after_each_batch(spark, tmp_path, rocks):
    rng = random.Random(5)
    schema = "file string, seq long, at string, side string"
    rows = [(f"/{show}/e.json", rng.randint(1, 6), f"2024-05-{rng.randint(1, 28):02d}", side) for show in "ab" for side in ("edited", "produced") for _ in range(14)] + [("/a/e.json", None, "2024-01-01", "edited"), ("/a/e.json", 1, None, "produced")]
    rng.shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).json(str(folder))
    changes = pending.pending_stream(stream.where("side = 'edited'"), stream.where("side = 'produced'"), ["file"])
    parts, seen = [rows[i::4] for i in range(4)], []
    parts[0] += [("/a/e.json", 9, "2024-05-02", "edited"), ("/a/e.json", 9, "2024-05-01", "produced")]
    parts[3].append(("/a/e.json", 9, "2024-05-03", "produced"))

    def write(part):
        seen.extend(part)
        name = f"{len(list(folder.iterdir()))}.json"
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("file", "seq", "at", "side"), r))) for r in part))
        (tmp_path / name).rename(folder / name)

    for told in run_batches(changes, tmp_path, "pending", "update", parts, write):
        every = spark.createDataFrame(seen, schema).where("seq IS NOT NULL AND at IS NOT NULL")
        want = joins.pending(every.where("side = 'edited'"), every.where("side = 'produced'"), ["file", "seq"], "at").select("file", "seq", "edited", "produced")
        stored = spark.createDataFrame([(*row, n) for n, row in enumerate(told)], "file string, seq long, edited string, produced string, pending boolean, batch int") if told else None
        got = [] if stored is None else pending.waiting(stored, ["file"]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert [row[1:] for row in told if row[1] == 9] == [(9, "2024-05-02", "2024-05-01", True), (9, "2024-05-02", "2024-05-03", False)]
