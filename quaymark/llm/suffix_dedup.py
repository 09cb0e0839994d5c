"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A string of LENGTH bytes that starts in two places is cut out of both. A passage that is shorter, but of more than WORDS
whole words and at least LEAST bytes, and occurs again, is reported. Either is found through the anchors it holds. A
position is an anchor if the eight bytes there hash below a bound; it is one as well if no anchor starts within a gap of
bytes from it. Both rules look only at what follows the position, so equal strings hold their first anchor at the same
offset, which is below the gap. It is therefore enough to sort the suffixes that start at anchors, and to compare what
stands before them:

1. Texts that are equal as a whole count once; a text with an equal one is covered where it is LENGTH bytes or longer.
2. Anchors whose next LEAST - gap bytes occur nowhere else are left out. They are counted by hash, whose accidents only
   leave too many in.
3. The other suffixes, LENGTH bytes of each, are sorted in runs where their texts are. Within a run, suffixes with equal
   contexts (bytes before back to the preceding anchor, and after) settle each other there, and one of them goes on, so a
   passage that very many texts share costs one suffix a run. A run is front-coded, each suffix as the length of the
   prefix it shares with its predecessor and the rest, and dealt by the hash of its first LEAST - gap bytes.
4. A task merges its runs with a loser tree that keeps, for every waiting suffix, the length of the prefix it shares
   with the last winner, so that known prefixes are never compared again. It yields the suffixes in order with the
   lengths of their common prefixes, of which those of LEAST - gap and more form a group.
5. In a group, pairs are joined from the longest common prefix down, the smaller side into the larger, and each suffix
   meets the neighbours of its reversed left context. For each suffix that gives every pair (left, right) of lengths
   that some other suffix matches and no other exceeds in both; where left + right reaches LENGTH, the bytes are covered,
   and where it reaches LEAST, the words in it are counted.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import WORD, drop, partitions, shared_dir, table

LENGTH = 400
#: Words that a passage exceeds, and the bytes it has at least.
WORDS, LEAST = 50, 240
#: One position in so many is an anchor.
DENSITY = 28
#: Bytes of text whose suffixes make one run; tasks that merge for each shuffle partition, and bytes of text for one at most;
#: parts for each task, so that hashing deals them evenly and a task holds the runs of few suffixes at a time.
RUN_BYTES = 2_500_000
SPREAD, PART_BYTES, PARTS = 2, 16_000_000, 8

_WORD = re.compile(WORD.encode())
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _words(buf: bytes) -> np.ndarray:
    """Eight bytes as a number, at every position."""
    a = np.frombuffer(buf + b"\0" * 8, np.uint8)
    return np.ndarray((len(buf),), "<u8", a, 0, (1,))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gap_of(length: int) -> int:
    return length * 3 // 5


def anchors(text: bytes, length: int, gap: int, density: int = DENSITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of strings of length bytes, and for how many starts back each is the first anchor (at least 1)."""
    n = len(text)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = _words(text)[: n - 7]
    hit = np.flatnonzero(w * _MUL < np.uint64((1 << 64) // density))
    edges = np.concatenate([[-1], hit, [n + gap]])
    wide = np.flatnonzero(np.diff(edges) > gap)
    dense = [np.arange(edges[i] + 1, min(edges[i + 1] - gap, n - length) + 1) for i in wide]
    hit = hit[hit <= n - (length - gap)]
    back = np.diff(np.concatenate([[-1], hit]))
    pos, back = np.concatenate([hit, *dense]), np.concatenate([np.minimum(back, gap), *(np.ones(len(d), np.int64) for d in dense)])
    order = np.argsort(pos, kind="stable")
    return pos[order], back[order]


def context_hashes(text: bytes, pos: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes after each position; size is a multiple of 8."""
    w = _words(text)
    h = np.full(len(pos), np.uint64(size))
    for j in range(0, size, 8):
        h = _mixed(h * np.uint64(0xBF58476D1CE4E5B9) + w[pos + j])
    return h


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, from what is known to be common."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        end = min(n, at + step)
        if a[at:end] != b[at:end]:
            x = int.from_bytes(a[at:end], "little") ^ int.from_bytes(b[at:end], "little")
            return at + ((x & -x).bit_length() - 1) // 8
        at = end
        step *= 4
    return n


class LoserTree:
    """Merges front-coded runs. Each run yields (common prefix with its predecessor, suffix, payload)."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        k = 1
        while k < max(1, len(self.runs)):
            k *= 2
        self.k = k
        self.head: list = [next(r, None) for r in self.runs] + [None] * (k - len(self.runs))
        self.lcp = [0] * k  # with the last winner
        self.loser = [0] * k
        win = list(range(k))
        while len(win) > 1:  # the first round; all prefixes known so far are empty
            up = []
            for i in range(0, len(win), 2):
                w, lose = self._play(win[i], win[i + 1])
                self.loser[len(win) // 2 + i // 2] = lose
                up.append(w)
            win = up
        self.winner = win[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        la, lb = self.lcp[a], self.lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        n = common(x[1], y[1], la)
        if (x[1][n : n + 1], a) <= (y[1][n : n + 1], b):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self):
        """(common prefix with the previous suffix, suffix, payload) in order."""
        while (out := self.head[self.winner]) is not None:
            i = self.winner
            yield self.lcp[i], out[1], out[2]
            nxt = next(self.runs[i], None)
            self.head[i] = nxt
            self.lcp[i] = nxt[0] if nxt is not None else 0
            node, w = (self.k + i) // 2, i
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


def encode_run(items: list[tuple[bytes, tuple]]) -> bytes:
    """Sorted (suffix, (cls, pos, back, left)) front-coded."""
    out, last = [struct.pack("<I", len(items))], b""
    for suffix, (cls, pos, back, left) in items:
        n = common(last, suffix)
        out.append(struct.pack("<HHqqHH", n, len(suffix) - n, cls, pos, back, len(left)))
        out.append(suffix[n:])
        out.append(left)
        last = suffix
    return b"".join(out)


def decode_run(data: bytes):
    """The run again, one suffix at a time."""
    (n,), at, last = struct.unpack_from("<I", data), 4, b""
    for _ in range(n):
        lcp, size, cls, pos, back, m = struct.unpack_from("<HHqqHH", data, at)
        at += 24
        last = last[:lcp] + data[at : at + size]
        at += size
        yield lcp, last, (cls, pos, back, data[at : at + m])
        at += m


def group_matches(lcps: list[int], lefts: list[bytes], backs: list[int], length: int, least: int):
    """For each suffix of a sorted group, ranges (from, to) of offsets d: the string of length bytes that starts d before it
    occurs again; and matches (left, right) that are shorter, but least bytes or more.

    lcps[i] is the common prefix of suffixes i-1 and i, lefts the reversed left contexts. A suffix is the first anchor of
    the starts up to back - 1 before it.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    best = [-1] * n

    def meet(i: int, j: int, right: int) -> None:
        left = common(lefts[i], lefts[j])
        for x in (i, j):
            to = min(left, backs[x] - 1)
            if left > best[x] or best[x] < 0:
                best[x] = left
                if length - right <= to:
                    out[x].append((max(0, length - right), to))
                elif to + right >= least:
                    short[x].append((to, right))

    parent, members = list(range(n)), [[rank[i]] for i in range(n)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(1, n), key=lambda k: -lcps[k]):
        a, b = find(k - 1), find(k)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big = members[a]
        for r in members[b]:
            at = bisect_left(big, r)
            if at:
                meet(order[big[at - 1]], order[r], lcps[k])
            if at < len(big):
                meet(order[big[at]], order[r], lcps[k])
            big.insert(at, r)
        parent[b] = a
        members[b] = []
    return out, short


def _runs(texts, pids: int, length: int, least: int):
    """From (cls, text, positions) of some texts: (pid, run) blobs, and (cls, from, to) spans that are settled in the run.

    pid is of the hash of the bytes that all suffixes of a group have in common.
    """
    gap = gap_of(least)
    items: dict[bytes, list] = {}
    for cls, text, keep in texts:
        pos, back = anchors(text, least, gap)
        take = np.isin(pos, keep)
        pos, back = pos[take], back[take]
        part = context_hashes(text, pos, (least - gap) // 8 * 8) % np.uint64(pids)
        for p, b, pid in zip(pos.tolist(), back.tolist(), part.tolist()):
            key = (text[p : p + length], text[max(0, p - b + 1) : p][::-1])
            if (places := items.get(key)) is None:
                items[key] = [(cls, p, b, pid)]
            else:
                places.append((cls, p, b, pid))
    settled, runs = [], {}
    for (suffix, left), places in items.items():
        if len(places) > 1:
            # all these starts see the same bytes before and after, so each occurs again
            near, far = max(0, length - len(suffix)), len(left)
            if far >= near:
                settled += [(cls, p - far, p - near + length) for cls, p, _, _ in places]
            elif far + len(suffix) >= least:
                settled += [(cls, p - far, p + len(suffix)) for cls, p, _, _ in places]
            cls, p = -1, 0
        else:
            cls, p = places[0][:2]
        runs.setdefault(places[0][3], []).append((suffix, (cls, p, places[0][2], left)))
    return {pid: encode_run(sorted(r, key=lambda x: x[0])) for pid, r in runs.items()}, settled


def merge_group(blobs: list[bytes], length: int = LENGTH, least: int = LEAST):
    """(cls, from, to) spans from all runs of a part, in the order in which the merge completes groups. Spans of less than
    length bytes are short matches."""
    known = least - gap_of(least)

    def finish(group):
        if len(group) < 2:
            return
        found = group_matches([g[0] for g in group], [g[2][3] for g in group], [g[2][2] for g in group], length, least)
        for (_, _, (cls, pos, _, _)), ranges, short in zip(group, *found):
            if cls >= 0:
                for lo, hi in ranges:
                    yield cls, pos - hi, pos - lo + length
                for left, right in short:
                    yield cls, pos - left, pos + right

    group: list = []
    for lcp, suffix, payload in LoserTree([decode_run(b) for b in blobs]):
        if lcp < known:
            yield from finish(group)
            group = []
        group.append((lcp, suffix, payload))
    yield from finish(group)


def words_within(data: bytes, lo: int, hi: int) -> int:
    """Whole words of data[lo:hi]; one that goes on beyond an end is none."""
    found = [m.span() for m in _WORD.finditer(data, lo, hi)]
    if found and found[0][0] == lo and lo and _WORD.match(data, lo - 1):
        del found[0]
    if found and found[-1][1] == hi and _WORD.match(data, hi):
        del found[-1]
    return len(found)


def union_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def apart(spans, length: int) -> list[tuple[int, int]]:
    """Spans of length bytes and more as their unions, and the distinct shorter ones that none of these holds."""
    long = union_spans(s for s in spans if s[1] - s[0] >= length)
    starts = [a for a, _ in long]
    short = {s for s in spans if s[1] - s[0] < length}
    return long + sorted(s for s in short if not (k := bisect_right(starts, s[0])) or long[k - 1][1] < s[1])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of from, to), repeated.

    Texts are UTF-8 bytes; null is empty, and a text shorter than length loses nothing. Matches stay within a text; equal
    strings within one text count, overlapping ones too. Rows that repeat an id or a text count one by one. repeated says
    that something was removed, or that the text has a passage of more than words words and at least least bytes that
    occurs again; shorter passages than that are not looked for.
    """
    gap = gap_of(least)
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    t = F.coalesce(F.col(text_col), F.lit(""))
    # rows are known by hashes of id and text, texts by a hash of their own, so rows that are read again are found again
    text_key = F.xxhash64("text").alias("w")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), t).alias("k1"), F.xxhash64(t, F.col(id_col), F.lit(1)).alias("k2"), t.alias("text"))
    seen = rows.select("k1", "k2", text_key, F.sha2("text", 256).alias("whole"), F.octet_length("text").cast("long").alias("n_bytes"))
    seen = table(seen.where(F.col("n_bytes") >= least), at, "seen")
    first = seen.groupBy("whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "w")).alias("k")).select(F.monotonically_increasing_id().alias("cls"), "copies", "whole", "k.*")
    classes = table(first, at, "classes")
    tasks = max(SPREAD * partitions(spark), (seen.agg(F.sum("n_bytes")).head()[0] or 0) // PART_BYTES)
    pids = PARTS * tasks

    # 2. anchors that occur again; equal texts give equal marks, which count once
    def marks(batches):
        import pyarrow as pa

        for batch in batches:
            done: set[int] = set()
            cs, hs, ps = [], [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if cls in done:
                    continue
                done.add(cls)
                data = text.as_py().encode("utf-8", "replace")
                pos, _ = anchors(data, least, gap)
                if len(pos):
                    cs.append(cls)
                    hs.append(context_hashes(data, pos, (least - gap) // 8 * 8))
                    ps.append(pos)
            if not cs:
                continue
            c, h, p = np.repeat(np.array(cs, np.int64), list(map(len, hs))), np.concatenate(hs), np.concatenate(ps).astype(np.uint32)
            part = h % np.uint64(pids)
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            idx = [order[i:j] for i, j in zip(cuts, cuts[1:])]
            cols = [pa.array([int(part[x[0]]) for x in idx], pa.int32()), *(pa.array([v[x].tobytes() for x in idx], pa.binary()) for v in (h, c, p))]
            yield pa.RecordBatch.from_arrays(cols, ["pid", "h", "cls", "pos"])

    marked = rows.select(text_key, "text").mapInArrow(marks, "pid int, h binary, cls binary, pos binary").repartition(tasks, "pid")

    def again(batches):
        import pyarrow as pa

        hs, cs, ps = [], [], []
        for batch in batches:
            for col, to, kind in ((1, hs, np.uint64), (2, cs, np.int64), (3, ps, np.uint32)):
                to += [np.frombuffer(x.as_py(), kind) for x in batch.column(col)]
        if not hs:
            return
        h, c, p = np.concatenate(hs), np.concatenate(cs), np.concatenate(ps)
        order = np.argsort(h, kind="stable")
        h, c, p = h[order], c[order], p[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        # a group counts if not all of it is one place of one text
        other = (c != c[start][group]) | (p != p[start][group])
        pick = np.flatnonzero(np.bincount(group, other)[group] > 0)
        for i in range(0, len(pick), 100_000):
            x = pick[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[x]), pa.array(p[x].astype(np.int64))], ["w", "pos"])

    kept = table(marked.mapInArrow(again, "w long, pos long").groupBy("w").agg(F.collect_set("pos").alias("pos")), at, "anchors")

    # 3. runs
    wanted = classes.select("cls", "copies", "k1", "k2", "w").join(kept, "w").drop("w")
    cand = table(rows.select("k1", "k2", "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"]), at, "candidates")
    drop(spark, at, "anchors")

    def sort_runs(batches):
        import pyarrow as pa

        def flush(texts):
            runs, settled = _runs(texts, pids, length, least)
            spans: dict[int, list] = {}
            for cls, lo, hi in settled:
                spans.setdefault(cls, []).append((lo, hi))
            rows = [(pid, blob, None, None) for pid, blob in runs.items()]
            rows += [(cls % pids, None, cls, [x for s in apart(v, length) for x in s]) for cls, v in spans.items()]
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], ["pid", "run", "cls", "spans"])

        texts, size = [], 0
        for batch in batches:
            for cls, text, pos in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py().encode("utf-8", "replace")
                texts.append((cls, data, np.asarray(pos.as_py(), np.int64)))
                size += len(data)
                if size > RUN_BYTES:
                    yield from flush(texts)
                    texts, size = [], 0
        if texts:
            yield from flush(texts)

    runs = cand.select("cls", "text", "pos").mapInArrow(sort_runs, "pid int, run binary, cls long, spans array<long>")

    # 4. merge
    def merge(batches):
        import pyarrow as pa

        part, blobs, spans = None, [], {}

        def flush():
            for cls, lo, hi in merge_group(blobs, length, least):
                spans.setdefault(cls, []).append((lo, hi))
            flat = [[x for s in apart(v, length) for x in s] for v in spans.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["cls", "spans"])
            blobs.clear()
            spans.clear()
            return out

        for batch in batches:  # in the order of parts
            for i, pid in enumerate(batch.column(0).to_pylist()):
                if pid != part:
                    if part is not None:
                        yield flush()
                    part = pid
                if (run := batch.column(1)[i]).is_valid:
                    blobs.append(run.as_py())
                else:
                    done = batch.column(3)[i].as_py()
                    spans.setdefault(batch.column(2)[i].as_py(), []).extend(zip(done[::2], done[1::2]))
        if part is not None:
            yield flush()

    found = runs.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(merge, "cls long, spans array<long>")
    found = table(found.groupBy("cls").agg(F.flatten(F.collect_list("spans")).alias("spans")), at, "spans")

    # 5. cut out of single texts; texts with copies go whole
    single = cand.where("copies = 1").select("cls", "k1", "k2", "text").join(found.hint("shuffle_hash"), "cls").select("k1", "k2", "text", "spans")

    def remove(batches):
        import pyarrow as pa

        for batch in batches:
            out = ([], [], [], [], [])
            for text, flat in zip(batch.column(2), batch.column(3).to_pylist()):
                data = text.as_py().encode("utf-8", "replace")
                every = apart(list(zip(flat[::2], flat[1::2])), length)
                spans = [s for s in every if s[1] - s[0] >= length]
                found = bool(spans) or any(words_within(data, lo, hi) > words for lo, hi in every)
                kept, last = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(data[last:lo])
                    last = hi
                kept.update(data[last:])
                for column, v in zip(out, (sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s], found)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_())))], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans", "repeated"])

    cut = table(single.mapInArrow(remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, repeated boolean"), at, "cut")
    drop(spark, at, "candidates", "spans")
    copied = seen.join(classes.where("copies > 1").select("whole"), "whole").select("k1", "k2", "n_bytes").dropDuplicates(["k1", "k2"])
    copied = copied.select("k1", "k2", F.lit(True).alias("copied"))
    every = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), F.when(F.octet_length("text") < length, F.regexp_count("text", F.lit(WORD))).alias("n_words"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return every.join(cut.unionByName(copied, allowMissingColumns=True), ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(gone, F.array(zero, "n_bytes")).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copied"), (F.col("n_bytes") >= length) | (F.col("n_words") > words)).otherwise(F.coalesce("repeated", F.lit(False))).alias("repeated"),
    )
