"""File arrival as a stream: every new file is detected, gated, parsed, written, verified and logged once.

The file source's checkpoint remembers which files were seen, and names that are known already are left out, so a rerun
ingests nothing twice. Every state is logged before its stage begins, so a pass that dies leaves what it was doing, and
resume() takes it up. A file that fails is logged with the state it failed in and doesn't stop the others. Work on one
file is distributed; workers files of a micro-batch go at the same time, and max_files bounds a batch.
"""

from __future__ import annotations

import itertools
import json
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path, PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaymark.config import FieldSpec, Layout, ParseConfig
from quaymark.sinks.parquet import load_metadata, open_dataset, save_metadata, verify, write
from quaymark.sources.detect import MAX_BYTES, Detection, detect
from quaymark.sources.files import SourceError, Transport, contents, discover, download, expand_bytes, is_compressed, leftovers
from quaymark.sources.records import KINDS, parse, rows, totals
from quaymark.streaming.lifecycle import DATASET_TRANSITIONS, FILE_TRANSITIONS, LOG, RECOVERY, RETRY, check, latest


def file_name(path: str) -> str:
    return PurePosixPath(unquote(urlparse(path).path)).name


def config_to_json(c: ParseConfig) -> str:
    layout = [[f.name, f.start, f.end] for f in c.layout.fields] if c.layout else None
    return json.dumps({"columns": list(c.columns), "delimiter": c.delimiter, "layout": layout, "header": c.header, "encoding": c.encoding, "skip_rows": c.skip_rows, "overrides": c.overrides})


def config_from_json(text: str) -> ParseConfig:
    x = json.loads(text)
    x["layout"] = Layout(tuple(FieldSpec(*f) for f in x["layout"])) if x["layout"] else None
    return ParseConfig(**x | {"columns": tuple(x["columns"])})


class Ingest:
    """root gets datasets/, metadata/, log/ (of files), dataset_log/ and checkpoint/."""

    def __init__(self, spark: SparkSession, inbox: str, root: str, layout: Layout | None = None, pattern: str | None = None, max_files: int = 100, delete_raw: bool = False, workers: int = 4):
        self.spark, self.inbox, self.root = spark, inbox.rstrip("/"), root.rstrip("/")
        self.layout, self.pattern, self.max_files, self.delete_raw = layout, pattern, max_files, delete_raw
        self.workers, self._tick = workers, itertools.count()

    # --- state log ---------------------------------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def log(self, name: str = "log") -> DataFrame:
        """The state log; empty if nothing was ever logged. A malformed entry is skipped, a log that can't be read is an error."""
        if not self._exists(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.root}/{name}").where("file_id is not null and seq is not null and status is not null")

    def states(self) -> DataFrame:
        return latest(self.log())

    def dataset_states(self) -> DataFrame:
        return latest(self.log("dataset_log"))

    def _seq(self) -> int:
        return time.time_ns() // 1000 * 1000 + next(self._tick) % 1000

    def _append(self, moves: list[tuple], name: str = "log") -> None:
        """moves: (file_id, status, error). A file of its own name for each call, so calls may overlap."""
        rows = [(f, self._seq(), s, e) for f, s, e in moves]
        text = "".join(json.dumps({k: v for k, v in zip(("file_id", "seq", "status", "error"), r) if v is not None}) + "\n" for r in rows)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{rows[0][1]}-{abs(hash(rows[0][0])) % 10**9}.json")
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _state(self, file_id: str) -> str | None:
        r = self.states().where(F.col("file_id") == file_id).select("status").head()
        return r[0] if r else None

    # --- one file ----------------------------------------------------------------------------------------------------

    def _detect(self, path: str) -> Detection:
        """From a bounded head, read by the JVM wherever the file is; compressed files are read whole."""
        raw = self.spark.read.format("binaryFile").load(path)
        head = raw.select("content" if is_compressed(path) else F.substring("content", 1, MAX_BYTES).alias("content")).head()[0]
        return detect(expand_bytes(path, bytes(head)), self.layout)

    def _run(self, path: str, config: ParseConfig | None, status: str) -> str:
        name, dataset = file_name(path), None

        def go(new: str, error: str | None = None) -> None:
            nonlocal status
            status = check(status, new)
            self._append([(path, new, error)])

        def dataset_go(new: str) -> None:
            nonlocal dataset
            dataset = new if dataset is None else check(dataset, new, DATASET_TRANSITIONS)
            self._append([(name, new, None)], "dataset_log")

        fail = "DETECTION_FAILED"
        try:
            if config is None:
                go("DETECTING")
                found = self._detect(path)
                config = found.auto_config()
                if config is None:
                    go("AWAITING_APPROVAL")
                    return status
            go("PARSING")
            fail = "PARSE_FAILED"
            config.validate()
            target = f"{self.root}/datasets/{name}"
            seen = Observation()
            # one parse: counts are taken while the rows are written
            records = parse(contents(self.spark, path, config.encoding), config).observe(seen, *totals(config))
            go("PARQUET_WRITING")
            fail = "WRITE_FAILED"
            dataset_go("CREATED")
            dataset_go("WRITING")
            done = write(rows(records, config), target, config.overrides)
            count = seen.get
            go("DATASET_VERIFYING")
            fail = "VERIFICATION_FAILED"
            dataset_go("VERIFYING")
            found = verify(self.spark, target, done.rows, done.columns)
            if not (found["rows_matched"] and found["columns_matched"]):
                raise RuntimeError(f"verification: {found}")
            meta = {"dataset": name, "status": "COMPLETE", "source": path, "rows": done.rows, "schema": done.schema, "config": config_to_json(config), "sha256": found["sha256"], "completed": self._seq()}
            meta |= {"counters": {k: v for k, v in count.items() if k not in KINDS}, "issues": {k: count[k] for k in KINDS if count[k]}}
            save_metadata(self.spark, f"{self.root}/metadata/{name}", meta)
            dataset_go("COMPLETE")
            go("COMPLETE")
            if self.delete_raw:
                status = self.cleanup(path)
        except Exception as e:
            fail = "DECOMPRESSION_FAILED" if isinstance(e, SourceError) and fail in ("DETECTION_FAILED", "PARSE_FAILED") else fail
            if dataset in ("WRITING", "VERIFYING"):
                dataset_go("FAILED")
            go(fail, str(e)[:500])
        return status

    def cleanup(self, path: str) -> str:
        """Deletes a raw file whose dataset is complete, and what its download or expansion left beside it."""
        status = check(self._state(path), "RAW_CLEANUP")
        self._append([(path, status, None)])
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, False)
            if path.startswith(("file:", "/")):
                leftovers(unquote(urlparse(path).path))
            status, error = "RAW_DELETED", None
        except Exception as e:
            status, error = "CLEANUP_FAILED", str(e)[:500]
        self._append([(path, status, error)])
        return status

    # --- passes ------------------------------------------------------------------------------------------------------

    def fetch(self, transport: Transport, folder: str) -> int:
        """Downloads what a share has and no log knows by name into the inbox, a folder of this machine. Returns how many came."""
        known = {file_name(r[0]) for r in self.states().select("file_id").collect()}  # a name a file ever seen
        at, n = Path(unquote(urlparse(self.inbox).path)), 0
        for name, size in discover(transport, folder, self.pattern):
            if name in known:
                continue
            path = f"file://{at / name}" if not self.inbox.startswith("/") else (at / name).as_uri()
            self._append([(path, s, None) for s in ("DISCOVERED", "DOWNLOAD_QUEUED", "DOWNLOADING")])
            try:
                download(transport, f"{folder.rstrip('/')}/{name}", at / name, size)
                self._append([(path, "DOWNLOAD_VERIFIED", None)])
                n += 1
            except (OSError, SourceError) as e:
                self._append([(path, "DOWNLOAD_FAILED", str(e)[:500])])
        return n

    def _each(self, work: list) -> None:
        with ThreadPoolExecutor(self.workers) as pool:
            for done in [pool.submit(f, *args) for f, *args in work]:
                done.result()

    def process(self) -> dict[str, int]:
        """One pass over what has arrived since the last one; returns how many files are in each state."""
        reader = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", self.max_files)
        if self.pattern:
            reader = reader.option("pathGlobFilter", self.pattern)

        def one(path: str, status: str | None) -> None:
            if status is None:
                self._append([(path, s, None) for s in ("DISCOVERED", "DOWNLOAD_QUEUED", "DOWNLOADING", "DOWNLOAD_VERIFIED")])
            self._run(path, None, "DOWNLOAD_VERIFIED")

        def batch(df: DataFrame, _epoch: int) -> None:
            name = F.element_at(F.split("file_id", "/"), -1)
            came = df.select(F.element_at(F.split("path", "/"), -1).alias("name"))
            known = {r[0]: (r[1], r[2]) for r in self.states().withColumn("name", name).join(came, "name", "left_semi").select("name", "file_id", "status").collect()}
            work = []
            for (path,) in df.select("path").orderBy("path").collect():  # at most max_files paths
                where, status = known.get(path.rsplit("/", 1)[-1], (path, None))
                if status in (None, "DOWNLOAD_VERIFIED"):
                    work.append((one, where, status))
                    known[path.rsplit("/", 1)[-1]] = (path, "DETECTING")
            self._each(work)

        query = reader.load(self.inbox).select("path").writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.status_counts()

    def status_counts(self) -> dict[str, int]:
        return {r["status"]: r["count"] for r in self.states().groupBy("status").count().collect()}  # at most one row a status

    def approve(self, path: str, config: ParseConfig) -> str:
        """Parses a file that waits for approval with the configuration a person has chosen."""
        config.validate()
        if self._state(path) != "AWAITING_APPROVAL":
            raise ValueError(f"{path} does not wait for approval")
        return self._run(path, config, "AWAITING_APPROVAL")

    def reprocess(self, path: str) -> str:
        """Detects a waiting file again."""
        if self._state(path) != "AWAITING_APPROVAL":
            raise ValueError(f"{path} does not wait for approval")
        return self._run(path, None, "AWAITING_APPROVAL")

    def resume(self, mapping: dict[str, str] | None = None) -> int:
        """Puts in-flight (or, with RETRY, failed) files back to their safe state and runs those that are downloaded; a clean-up
        that failed or was cut off is done again."""
        mapping = RECOVERY | {"RAW_CLEANUP": "COMPLETE"} if mapping is None else mapping

        def one(path: str, status: str) -> None:
            new = mapping[status]
            if new in ("COMPLETE", "RAW_CLEANUP"):
                self._append([(path, "COMPLETE", None)])
                self.cleanup(path)
                return
            moves = [new] if new != "DOWNLOAD_QUEUED" else [new, "DOWNLOADING", "DOWNLOAD_VERIFIED"]
            self._append([(path, s, None) for s in moves])
            self._run(path, None, "DOWNLOAD_VERIFIED")

        found = self.states().where(F.col("status").isin(*mapping)).orderBy("file_id").collect()  # files of interrupted passes
        self._each([(one, r["file_id"], r["status"]) for r in found])
        return len(found)

    def retry_failed(self) -> int:
        return self.resume(RETRY)

    def datasets(self) -> list[dict]:
        """Metadata of complete datasets, in the order of completion."""
        if not self._exists(f"{self.root}/metadata"):
            return []
        return sorted((m for m in load_metadata(self.spark, f"{self.root}/metadata/*") if m.get("status") == "COMPLETE"), key=lambda m: m.get("completed", 0))

    def open(self, name: str) -> DataFrame:
        if name not in {m["dataset"] for m in self.datasets()}:
            raise SourceError(f"no complete dataset {name!r}")
        return open_dataset(self.spark, f"{self.root}/datasets/{name}")


assert set(RETRY) <= set(FILE_TRANSITIONS)
