"""Byte-level BPE by merge replay over the distinct words of the corpus.

Texts are cut at white space first; a piece keeps its leading space. The pattern never matches across such a cut, so equal
pieces have equal ids, and three steps encode a corpus:

1. Every split of the corpus sends its distinct pieces to the parts their hashes belong to.
2. A part takes each piece once, whatever splits sent it, and replays the merges over the words of its pieces together. They
   are laid out one after the other as tokens with links to their neighbours. An inverted index from each adjacent pair,
   named by the rank it merges to, to its positions is the work list: ranks are taken in ascending order, every listed
   position that still holds the pair is merged, and only the pairs beside it are looked up again. A rank lower than the
   current one is taken at once, and positions of one rank from left to right, so each word goes through the same merges
   as if it were encoded alone. The part answers every split.
3. A split reads the answers, written in a file of its own, and puts its texts' ids together. Texts aren't shuffled. Pieces
   that have no answer, as long ones don't, are replayed where they are met, so ids never depend on how the corpus is split.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from functools import lru_cache

#: White space as the tokenizer libraries understand it.
_W = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: Longer pieces aren't remembered or sent, and the memory is emptied when it holds this many more than it was given.
LONGEST, MOST = 64, 250_000
#: Pieces that are replayed together, and pairs whose ranks are remembered.
TOGETHER, PAIRS = 50_000, 500_000
#: Parts for each task that answers, so that hashing deals them evenly and few pieces are held at a time.
SPREAD = 4


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes batches of distinct words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.tokens[r] = b
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}  # (left << 32 | right): rank of the two together, or -1

    def _rank(self, left: int, right: int) -> int:
        """What the pair merges to, or -1; remembered in pairs."""
        r = self.pairs[left << 32 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return r

    def _listed(self, token) -> dict[int, list[int]]:
        """The inverted index of all adjacent pairs that merge: rank to positions, ascending."""
        import numpy as np

        t = np.array(token, np.int64)
        at = np.flatnonzero((t[:-1] >= 0) & (t[1:] >= 0))
        keys, which = np.unique(t[at] << 32 | t[at + 1], return_inverse=True)
        known = self.pairs
        ranks = np.array([known[k] if k in known else self._rank(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], np.int64)[which] if len(at) else at
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        ranks, at = ranks[order], at[order].tolist()
        new = [*np.flatnonzero(np.diff(ranks, prepend=-1)).tolist(), len(at)]
        return {int(ranks[i]): at[i:j] for i, j in zip(new, new[1:])}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        ranks, rank_of, get = self.ranks, self._rank, self.pairs.get
        out: list[list[int] | None] = [None] * len(words)
        token: list[int] = []
        starts = []
        for i, w in enumerate(words):
            starts.append(len(token))
            if (r := ranks.get(w)) is not None:
                out[i] = [r]
            else:
                token += map(self.single.__getitem__, w)
                token.append(-1)  # no pair reaches across
        token.append(-1)
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        index = self._listed(token)
        todo = list(index)
        heapq.heapify(todo)
        while todo:
            rank = heapq.heappop(todo)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for k, i in enumerate(places):
                if (a := token[i]) < 0:
                    continue
                j = after[i]
                if (b := token[j]) < 0 or get(a << 32 | b) != rank:
                    continue  # touched since it was listed
                token[i], token[j] = rank, -2
                end = after[i] = after[j]
                before[end] = i
                lower, start = False, before[i]
                if start >= 0 and (a := token[start]) >= 0:
                    if (r := get(a << 32 | rank)) is None:
                        r = rank_of(a, rank)
                    if r >= 0:
                        if (at := index.get(r)) is None:
                            index[r] = [start]
                            heapq.heappush(todo, r)
                        else:
                            at.append(start)
                        lower = r <= rank
                if (b := token[end]) >= 0:
                    if (r := get(rank << 32 | b)) is None:
                        r = rank_of(rank, b)
                    if r >= 0:
                        if (at := index.get(r)) is None:
                            index[r] = [i]
                            heapq.heappush(todo, r)
                        else:
                            at.append(i)
                        lower |= r <= rank
                if lower and k + 1 < len(places):
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(todo, rank)
                    break
        for i, s in enumerate(starts):
            if out[i] is None:
                ids = []
                while token[s] >= 0:
                    ids.append(token[s])
                    s = after[s]
                out[i] = ids
        return out


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers, and back. known has pieces whose ids are there already."""

    def __init__(self, rank_file: str, pattern: str, known: dict[str, bytes] | None = None):
        import regex

        self.replay = MergeReplay(load_ranks(rank_file))
        self.words_of = regex.compile(pattern).findall
        self.pieces, self.learnt = known if known is not None else {}, []

    def learn(self, new: list[str]) -> dict[str, bytes]:
        split = [[w.encode("utf-8", "replace") for w in self.words_of(p)] for p in new]
        words = list(dict.fromkeys(w for ws in split for w in ws))
        packed = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(words, self.replay.encode(words))}
        return {p: b"".join([packed[w] for w in ws]) for p, ws in zip(new, split)}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.learnt) > MOST:
            for p in self.learnt:
                del self.pieces[p]
            self.learnt.clear()
        get, out, left = self.pieces.__getitem__, [], []
        for i, t in enumerate(texts):
            ps = PIECES.findall(t)
            try:
                out.append(b"".join(map(get, ps)))
            except KeyError:
                out.append(b"")
                left.append((i, ps))
        if left:
            learnt = self.learn(list(set().union(*(ps for _, ps in left)).difference(self.pieces)))
            short = [p for p in learnt if len(p) <= LONGEST]
            self.pieces.update((p, learnt[p]) for p in short)
            self.learnt += short
            for i, ps in left:
                out[i] = b"".join([learnt[p] if p in learnt else get(p) for p in ps])
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, memoryview(packed).cast("I")))


def _packed(pieces: list[str]) -> bytes:
    """Pieces that are no longer than LONGEST, in order, as one compressed frame: their number, lengths, a byte each, and
    characters. Sorted ones take about half of what they do as they come."""
    import zstandard

    data = struct.pack("<I", len(pieces)) + bytes(map(len, pieces)) + "".join(pieces).encode()
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(data)


def _pieces(frame: bytes) -> list[str]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(frame)
    n = struct.unpack_from("<I", data)[0] + 4
    return _unpacked(data[4:n], data[n:].decode())


def _unpacked(lengths, data, unit: int = 1):
    """Stretches of data, which is text or bytes, of these lengths in units."""
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n * unit)
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def learn_pieces(docs, rank_file: str, pattern: str, at: str, text_col: str = "text") -> str:
    """Writes the ids of the distinct pieces of every split of docs below the folder, and says where."""
    from pyspark.sql import functions as F

    from quaymark.llm.common import partitions, tidy

    texts = docs.select(F.col(text_col).alias("text"))
    tasks = max(partitions(docs.sparkSession), texts.rdd.getNumPartitions())
    parts = tasks * SPREAD

    def ask(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        split, found = TaskContext.get().partitionId(), set()

        def send():
            dealt: dict[int, list[str]] = {}
            for p in found:
                dealt.setdefault(zlib.crc32(p.encode()) % parts, []).append(p)
            rows = [(pid, split, _packed(sorted(ps))) for pid, ps in dealt.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["pid", "split", "pieces"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    found.update(PIECES.findall(text.as_py()))
                    if len(found) > MOST:
                        found.difference_update([p for p in found if len(p) > LONGEST])
                        yield send()
        found.difference_update([p for p in found if len(p) > LONGEST])
        yield send()

    width = "<u2" if max(load_ranks(rank_file).values()) < 1 << 16 else "<u4"

    def answer(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        enc, part, asked = Encoder(rank_file, pattern), None, []

        def flush():
            every, ids = set(), {}
            for r in asked:
                every.update(_pieces(r["pieces"]))
            every = list(every)
            for i in range(0, len(every), TOGETHER):
                ids.update(enc.learn(every[i : i + TOGETHER]))
            for r in asked:
                yield answered(r, ids)
            asked.clear()

        def answered(r, ids):
            found = [ids[p] for p in _pieces(r["pieces"])]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            data = sizes.astype("<u2").tobytes() + np.frombuffer(b"".join(found), "<u4").astype(width).tobytes()
            cols = [r["pieces"], zstandard.ZstdCompressor(level=3, write_checksum=False).compress(data)]
            return pa.RecordBatch.from_arrays([pa.array([r["split"]], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["split", "pieces", "ids"])

        for batch in batches:  # in the order of parts
            for i, pid in enumerate(batch.column(0).to_pylist()):
                if pid != part and asked:
                    yield from flush()
                part = pid
                asked.append({n: batch.column(n)[i].as_py() for n in ("split", "pieces")})
        if asked:
            yield from flush()

    asked = texts.mapInArrow(ask, "pid int, split int, pieces binary").repartition(tasks, "pid").sortWithinPartitions("pid")
    answers = asked.mapInArrow(answer, "split int, pieces binary, ids binary")
    path = f"{at}/pieces"
    with tidy(docs.sparkSession):
        answers.repartition(tasks, "split").write.partitionBy("split").option("compression", "zstd").parquet(path)
    return path


def known_pieces(path: str, split: int) -> dict[str, bytes]:
    """The pieces of a split with their ids; nothing where the corpus is split in another way now."""
    import numpy as np
    import zstandard
    from pyarrow import fs, parquet

    files, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out: dict[str, bytes] = {}
    for f in files.get_file_info(fs.FileSelector(f"{base}/split={split}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            for r in parquet.ParquetFile(files.open_input_file(f.path)).read(["pieces", "ids"]).to_pylist():
                pieces, data = _pieces(r["pieces"]), zstandard.ZstdDecompressor().decompress(r["ids"])
                sizes = np.frombuffer(data, "<u2", len(pieces))
                rest = data[2 * len(pieces) :]
                ids = np.frombuffer(rest, "<u4" if len(rest) == 4 * sizes.sum() else "<u2").astype("<u4").tobytes()
                out.update(zip(pieces, _unpacked(sizes.tolist(), ids, 4)))
    return out


def encode_documents(docs, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True):
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array of int).

    Null and empty texts have no ids. No special tokens: their strings are ordinary text. Texts are read in Arrow batches,
    cut further by size, so memory holds a few texts and the pieces of a split. Repeated rows give repeated rows, an empty
    table an empty one; other columns don't matter.
    """
    from pyspark.sql import functions as F

    from quaymark.llm.common import shared_dir

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    learnt = learn_pieces(docs, rank_file, pattern, shared_dir(docs.sparkSession), text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = Encoder(rank_file, pattern, known_pieces(learnt, TaskContext.get().partitionId()))
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                part, size = [], 0
                end = at
                while end < len(texts) and size < 2_000_000:
                    part.append(texts[end].as_py() or "")
                    size += len(part[-1])
                    end += 1
                packed = enc.encode(part)
                cols = [
                    ids_col.slice(at, end - at),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in packed]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([memoryview(x).cast("i").tolist() for x in packed], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
