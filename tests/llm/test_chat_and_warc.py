import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat_format, warc


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


HARD = ["", "\\", "\\\\", "[INST]", "[\\INST]", "\\[INST]", "</s>", "<\\/s>", "<</s>>", "[INST", "INST]", "[[INST]]", " [/INST]", "[TEXT]", "$1 \\1", "[ANS] x</s>", "é[INST]é\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(k, 2 * i + j, role, text) for k, text in enumerate(HARD) for i in range(2) for j, role in enumerate(("user", "assistant"))]
    rows += [(100 + k, 0, text, text) for k, text in enumerate(HARD)]  # roles that are no roles
    out = chat_format.format_chat(chats(spark, rows)).select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), "segments", "formatted").collect()
    for r in out:
        expected = [(a[2], a[3]) for a in sorted(x for x in rows if x[0] == r.conv_id)]
        assert [(t.role, t.text) for t in r.t] == expected
        assert "".join(s.text for s in r.segments) == r.formatted


def test_machine_nulls_ties(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", None), (4, 0, None, "x"), (None, 0, "user", "u"), (None, 1, "assistant", "v"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, None, "system", "s")]
    out = {r.conv_id: r for r in chat_format.format_chat(chats(spark, rows)).collect()}
    assert {k: r.wrong_turn for k, r in out.items()} == {1: None, 2: 0, 3: 1, 4: 0, None: None, 5: 2}
    assert out[1].valid and not out[3].valid
    assert out[5].formatted.index("[SYS] s") < out[5].formatted.index("[INST] a") < out[5].formatted.index("[INST] b")
    assert [s.text for s in out[1].segments if s.loss] == ["a"]
    assert chat_format.format_chat(chats(spark, rows).filter("false")).count() == 0


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat_format.Template("<s>", {"user": chat_format.Turn("<a<b> ", " x")}, chat_format.Turn("[o] ", " [/o]"), " [m] ", {}, frozenset())


def test_query_against_sql(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for m, key in ((chat_format, "conv_id"), (warc, "page_id")):
        got = m.query(spark, sf).toPandas()
        expected = con.sql(m.ORACLE_SQL).df()[list(got.columns)]
        a, b = (x.sort_values(key).reset_index(drop=True).astype(str).replace({"None": "nan", "<NA>": "nan"}) for x in (got, expected))
        assert a.equals(b)


def test_native_plan(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plan = chat_format.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_archives_with_false_magic(spark, tmp_path):
    false = "x" * 1200 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nfoo"
    jump = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 90\r\n\r\n" + "y" * 40  # a false record whose end lies in the next one
    rows = [(1, "u", false), (2, "u", false), (3, None, None), (4, "u\r\nX: y", "WARC/1.1\r\n"), (5, "u", jump), (6, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", ""), (9, "u", "WARC/1.1\r\n" * 50), (9, "u", "other"), (None, "u", "no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit("clash"))
    for k, per_file in enumerate((3, 1000)):
        path = str(tmp_path / f"w{k}")
        warc.write(df.coalesce(1), path, per_file)
        got = warc.read(spark, path).collect()
        expected = []
        for i, _, html in rows:
            data = (html or "").encode()
            top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
            again = len(data) >= 1000 and i is not None and i < top
            expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_split_archives(spark, tmp_path):
    """Files without compression are read by many tasks; offsets still add up."""
    rows = [(k, f"u{k}", f"payload {k} " * (k % 50) + "WARC/1.1\r\n" * (k % 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "plain")
    warc.records(df).coalesce(1).write.option("lineSep", "\r\n").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r.page_id: r.payload_digest for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: hashlib.sha1(h.encode()).hexdigest() for k, _, h in rows}


def test_empty_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_broken_archives_are_told(spark, tmp_path):
    """A wrong length, a line before the first record, a file cut off, a file that is no archive: errors, or the records up to there."""
    rows = [(k, "u", f"page {k} " * 5) for k in range(6)]
    warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1).write.option("lineSep", "\r\n").text(str(tmp_path / "sound"))
    (whole,) = [p for p in (tmp_path / "sound").iterdir() if p.name.startswith("part-")]
    sound = whole.read_bytes()
    length = len(b"page 2 ") * 5
    third = sound.index(b"page 2 ")
    at = sound.rindex(b"Content-Length: ", 0, third)
    cases = {
        "length": (sound[:at] + sound[at:].replace(f"Content-Length: {length}".encode(), f"Content-Length: {length + 3}".encode(), 1), 3),
        "before": (b"\n" + sound, 0), "cut": (sound[:-9], 6), "text": (b"no archive at all", 0), "more": (sound + b"x", 6),
    }
    for name, (data, n) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(ValueError, match="a.warc at byte"):
            warc.read(spark, str(tmp_path / name))
        assert warc.read(spark, str(tmp_path / name), broken="keep").count() == n, name
    assert warc.read(spark, str(tmp_path / "sound")).count() == 6
