"""Token ids in shard files: every document is a zstandard frame of its own, compressed with one shared dictionary.

A shard file holds, in order: MAGIC, the dictionary's SHA-256, the frames, an index with a record (offset, compressed
length, ids, id of the document, has an id) for each document, and a tail (index offset, documents, ids in all). A
reader checks the dictionary's hash and can fetch any document by one seek. The dictionary is a file beside the shards.

The dictionary is trained on serialised id arrays of a bounded sample: about SAMPLE texts, those whose hash is low enough
for their share of all rows, equal rows once, of which at most SAMPLE_BYTES are used; compression with it is lossless
whatever the sample.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.bpe import LONGEST, MOST, PIECES
from quaymark.llm.common import partitions, shared_dir

MAGIC = b"QTOK2\0\0\0"
RECORD = struct.Struct("<QIIqB")
TAIL = struct.Struct("<QQQ8s")
SAMPLE, SAMPLE_BYTES, DICT_BYTES, LEVEL = 2000, 8_000_000, 65_536, 3
#: How byte-level vocabularies write the byte of a space, and how many pieces go to the library in one string.
SPACE_TOKEN, TOGETHER = "\u0120", 2048


class LibraryEncoder:
    """Ids by the tokenizers library, which is asked once for every distinct piece between white space.

    Texts are cut at each space that a character other than white space follows; byte-level pre-tokenizers never reach
    across such a place. Most pieces are a space and a run without white space: many of them go to the library as one
    string, and a token whose bytes start with a space starts the next piece. All other pieces go to it one by one.
    Pieces that were met again are kept when the memory is full of others, as most of a corpus's pieces occur once.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE_TOKEN) for i in range(size)])
        self.after: dict[str, bytes] = {}  # pieces with a space before them, which is left out of the key
        self.met: set[str] = set()  # those of them that later texts had too
        self.whole: dict[str, bytes] = {}  # all others

    def _learn(self, new: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [struct.pack(f"<{len(e.ids)}{code}", *e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _learn_after(self, new: list[str]) -> list[bytes]:
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u2" if self.width == 2 else "<u4")
            places = np.flatnonzero(self.starts[ids])
            if len(places) != len(some) or places[0]:  # no byte-level vocabulary
                out += self._learn([f" {p}" for p in some])
                continue
            packed, ends = ids.tobytes(), [*(places * self.width).tolist(), len(ids) * self.width]
            out += [packed[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of `width` bytes."""
        if len(self.whole) > MOST:
            self.whole.clear()
        cut, other = [], set()
        split = [t.split(" ") for t in texts]
        every = set().union(*(rest[1:] for rest in split))
        self.met |= every.intersection(self.after)
        if len(self.met) > 2 * MOST:
            self.after.clear()
            self.met.clear()
        elif len(self.after) - len(self.met) > MOST:
            self.after = {p: self.after[p] for p in self.met}
        plain = every.difference(self.after)
        wide = {p for p in plain if not p or p[0].isspace()}  # where there is longer white space
        odd = [not wide.isdisjoint(rest[1:]) for rest in split] if wide else [False] * len(split)
        if wide:
            plain = set().union(*(rest[1:] for rest, o in zip(split, odd) if not o)).difference(self.after)
        for t, (first, *rest), o in zip(texts, split, odd):
            if o:
                first, rest = None, PIECES.findall(t)
                other.update(set(rest).difference(self.whole))
            elif first not in self.whole:
                other.add(first)
            cut.append((first, rest))
        others, spaced, joined = list(other), [], []
        for p in plain:
            (joined if len(p) <= LONGEST and len(p.split()) == 1 else spaced).append(p)
        after, whole = self.after, self.whole
        long_after, long_whole = {}, {}
        for p, ids in zip(others, self._learn(others) if others else []):
            (whole if len(p) <= LONGEST else long_whole)[p] = ids
        for p, ids in zip(spaced, self._learn([f" {p}" for p in spaced]) if spaced else []):
            (after if len(p) <= LONGEST else long_after)[p] = ids
        after.update(zip(joined, self._learn_after(joined)))
        out = []
        for first, rest in cut:
            known, more = (whole, long_whole) if first is None else (after, long_after)
            ids = map(known.__getitem__, rest) if not more else (known[p] if p in known else more[p] for p in rest)
            out.append((b"" if first is None else whole[first] if first in whole else long_whole[first]) + b"".join(ids))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    """One for all tasks of a Python worker, with what it remembers."""
    return LibraryEncoder(path)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """The dictionary, or nothing where there is too little to learn from; documents are then compressed without one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """Writes under a name of its own and renames at the end, so a task that runs twice leaves one whole file."""

    def __init__(self, folder: str, shard: int, dictionary: bytes, width: int):
        import zstandard

        self.fs, base = _fs(folder)
        self.final = f"{base}/shard-{shard:06d}.qtok"
        self.temp = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())
        self.at = len(MAGIC) + 33
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dictionary)).compress
        self.index, self.ids, self.width = [], 0, width

    def add(self, doc_id: int | None, packed: bytes) -> None:
        frame = self.compress(packed)
        self.out.write(frame)
        n = len(packed) // self.width
        self.index.append(RECORD.pack(self.at, len(frame), n, doc_id or 0, doc_id is not None))
        self.at += len(frame)
        self.ids += n

    def close(self) -> tuple[int, int]:
        self.out.write(b"".join(self.index) + TAIL.pack(self.at, len(self.index), self.ids, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.final)
        return len(self.index), self.ids


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        files, base = _fs(path)
        self.file = files.open_input_file(base)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        size = self.file.size()
        at, self.count, self.ids, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        if head[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.width = head[len(MAGIC)]
        self.index = self.file.read_at(RECORD.size * self.count, at)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dict(dictionary)).decompress

    def __len__(self) -> int:
        return self.count

    def packed(self, i: int) -> tuple[int | None, bytes]:
        at, size, n, doc_id, known = RECORD.unpack_from(self.index, i * RECORD.size)
        return doc_id if known else None, self.decompress(self.file.read_at(size, at), max_output_size=max(1, n * self.width))

    def ids_of(self, i: int):
        import numpy as np

        return np.frombuffer(self.packed(i)[1], "<u2" if self.width == 2 else "<u4")

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes shards in ascending order of ids (null first). Returns (shard, docs, ids).

    Null text is empty text and has the end id alone. Rows that repeat an id stand side by side. An empty table writes no
    shards. folder must be one that driver and executors share.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, SAMPLE / max(1, rows.count()))
    hashed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    sample = sorted((tuple(r) for r in hashed.dropDuplicates(["h"]).limit(2 * SAMPLE).collect()), key=lambda r: r[0])
    enc, samples, size = LibraryEncoder(tokenizer_path), [], 0
    for at in range(0, len(sample), 50):
        samples += enc.encode([text for _, text in sample[at : at + 50]])
        size = sum(map(len, samples))
        if size > SAMPLE_BYTES:
            break
    dictionary = train_dictionary([s for s in samples if s])
    files, base = _fs(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/dictionary") as f:
        f.write(dictionary)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, writer, enc = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                part, size, end = [], 0, at
                while end < len(texts) and size < 2_000_000:
                    part.append(texts[end].as_py())
                    size += len(part[-1])
                    end += 1
                if writer is None:
                    enc = encoder(tokenizer_path)
                    stop = end_id.to_bytes(enc.width, "little")
                    writer = ShardWriter(folder, shard, dictionary, enc.width)
                for doc_id, packed in zip(ids.slice(at, end - at).to_pylist(), enc.encode(part)):
                    writer.add(doc_id, packed + stop)
                at = end
        if writer is not None:
            n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    written = ordered.mapInArrow(run, "shard int, docs long, ids long")
    return spark.createDataFrame(written.collect(), "shard int, docs long, ids long")  # one row a shard file


def read_tokens(spark, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files; start counts all ids before it."""
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files, base = _fs(folder)
    with files.open_input_stream(f"{base}/dictionary") as f:
        dictionary = f.read()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(f"{folder}/shard-{shard:06d}.qtok", dictionary)
                at, out = first, ([], [], [], [])
                for i in range(len(reader)):
                    doc_id, packed = reader.packed(i)
                    wide = packed if reader.width == 4 else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                    for column, v in zip(out, (doc_id, at, len(wide) // 4, zlib.crc32(wide))):
                        column.append(v)
                    at += len(wide) // 4
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    todo = starts.repartition(max(1, min(partitions(spark), shards.count())), "shard")
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, tokenizer_path, folder))
