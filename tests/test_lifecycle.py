import gzip

import pytest

from quaymark.config import ParseConfig
from quaymark.streaming import lifecycle as lc
from quaymark.streaming.ingest import Ingest

PATH = ["DISCOVERED", "DOWNLOAD_QUEUED", "DOWNLOADING", "DOWNLOAD_VERIFIED", "DETECTING", "PARSING", "PARQUET_WRITING", "DATASET_VERIFYING", "COMPLETE", "RAW_CLEANUP", "RAW_DELETED"]


def test_transitions():
    for a, b in zip(PATH, PATH[1:]):
        assert lc.check(a, b) == b
    with pytest.raises(lc.IllegalTransition):
        lc.check("DISCOVERED", "PARSING")
    assert lc.RETRY["DOWNLOAD_FAILED"] == "DOWNLOAD_QUEUED" and lc.RETRY["CLEANUP_FAILED"] == "RAW_CLEANUP" and lc.RETRY["PARSE_FAILED"] == "DOWNLOAD_VERIFIED"
    assert lc.is_terminal("RAW_DELETED") and not lc.is_terminal("COMPLETE")


def test_log_operators(spark):
    log = spark.createDataFrame([("a", i, s, None) for i, s in enumerate(PATH[:6])] + [("b", 1, "DISCOVERED", None), ("b", 2, "PARSING", None)], lc.LOG)
    assert {r["file_id"]: r["status"] for r in lc.latest(log).collect()} == {"a": "PARSING", "b": "PARSING"}
    assert [tuple(r) for r in lc.illegal_transitions(log).collect()] == [("b", 2, "DISCOVERED", "PARSING")]
    assert {r["status"] for r in lc.recovered(lc.latest(log)).collect()} == {"DOWNLOAD_VERIFIED"}
    assert lc.retried(lc.latest(log)).count() == 0


def test_ingest(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"f{i}.csv").write_text(f"STORE,UNITS\n{i},2\n{i + 1},3\n")
    (inbox / "g.csv.gz").write_bytes(gzip.compress(b"A,B\n1,2\n3,4\n"))
    (inbox / "bad.csv.gz").write_bytes(b"not gzip")
    (inbox / "wait.csv").write_text("n\nm\na,b\n1,2\n3,4\n")
    job = Ingest(spark, str(inbox), str(tmp_path / "root"))
    assert job.process() == {"COMPLETE": 4, "DECOMPRESSION_FAILED": 1, "AWAITING_APPROVAL": 1}
    n = job.log().count()
    assert job.process()["COMPLETE"] == 4 and job.log().count() == n
    assert lc.illegal_transitions(job.log()).count() == 0
    waiting = job.states().where("status = 'AWAITING_APPROVAL'").head()["file_id"]
    assert job.approve(waiting, ParseConfig(columns=("a", "b"), delimiter=",", skip_rows=2, overrides={"a": "Int64"})) == "COMPLETE"
    assert [r["a"] for r in job.open("wait.csv").orderBy("a").collect()] == [1, 3]
    assert len(job.datasets()) == 5 and job.retry_failed() == 1
