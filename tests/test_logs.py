from castline.operators import logs
from castline.sources import readers

LOG = """--- Phase 1: Generating
> [7] adam with eleven_v2 (12 chars)
Saved: stems/S01E01/007_a.mp3
SHA256: aa11
> [8] eve via gTTS (3 chars)
SHA256: bb
Saved: stems/S01E01/008_e.mp3
> [9] eve via Chatterbox Turbo (4 chars)
Saved: stems/S01E01/009_e.mp3
2024-05-01T10:00:00Z|INFO|host|produce|BEGIN produce
2024-05-01T10:00:01Z|INFO|host|produce|> [9] eve via chatterbox (4 chars)
2024-05-01T10:00:02Z|INFO|host|produce|  Saved: stems/S01E02/009_e.mp3
2024-05-01T10:00:02Z|INFO|host|produce|  Saved: other.mp3
2024-05-01T10:00:03Z|INFO|host|produce|  SHA256: CC
"""


def test_production_log(spark, tmp_path):
    (tmp_path / "log_2024-05-01.log").write_text(LOG)
    records = logs.production_records(readers.log_lines(spark, str(tmp_path)))
    got = [(r.log_date, r.run_index, r.log_line, r.seq, r.speaker, r.backend, r.char_count, r.stem_filename, r.sha256) for r in records.orderBy("log_line").collect()]
    assert got == [("2024-05-01", 1, 3, 7, "adam", "eleven_v2", 12, "007_a.mp3", "aa11"), ("2024-05-01", 2, 12, 9, "eve", "chatterbox", 4, "009_e.mp3", "CC")]
    assert logs.filter_records(records, since="2024-05-02").count() == 0
    assert [r.seq for r in logs.filter_records(records, tag="s01e02").collect()] == [9]


