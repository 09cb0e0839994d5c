"""A hashed maximum-entropy language model with a class-factored softmax, and a unigram base score.

A word's last two bytes are hashed to one of CLASSES classes, and the word to one of MEMBERS members of its class. A token
is predicted in three factors. First its class, by a softmax over sums of weights: a row for the classes of the two words
before (an n-gram feature), a row for the class of the word before the last one (a skip feature), and a row of the last
word's own. Then its member, by a softmax over a row for its class and the class of the word before. Then the word, by its
share of the training tokens of class and member, with one added for each word and one for any unknown word. The factors
multiply to a proper distribution. Every word with LEAST training tokens has a row of its own, in a corpus of any size, so
what is gathered of contexts grows with the corpus.

Training is distributed. Texts are turned into blocks of token numbers once. Rows of class contexts start from smoothed
counts, rows of words from what their counts say beside the row of their class. Then ROUNDS gradient rounds, each over
another part of the training texts, run the model forward, sum the observed and the expected counts of every row, and
move its weights by a part of the logarithm of one over the other, both smoothed. The member softmax has one feature a
token, so its smoothed counts are where its gradient rounds would end.

Words meet their counts and weights by an exchange: each block sends its words to the parts their hashes belong to, a
part adds up what it gets and answers every block. A word is sent once a block, however often it occurs. Answers are
written in a folder for each split of the corpus, where its blocks read them, so blocks are never shuffled. Blocks and
parts are of bounded size, so their numbers grow with the corpus; only the rows of class contexts, whose number is fixed,
come to the driver and are broadcast.

Weights are exchanged by split, not by block. What a word was followed by is sent in one of two ways, which add up to the
same sums: of a word with more than FEW tokens in a split, the split has the weights and sends observed and expected counts
of all classes; of any other it sends each token's class context and class, and the part, which has the weights, runs the
model forward. Most words are rare in a split, so this is a small part of what a row of counts for each would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import drop, partitions, shared_dir, table, tidy

CLASSES, MEMBERS = 64, 16
#: A word has weights of its own if it has this many training tokens, however many there are in all.
LEAST = 32
#: Tokens of a word in a split up to which they are sent one by one, and tokens that a split holds before it sends them.
FEW, HELD_BACK = 64, 8_000_000
ROUNDS = 2
#: Smoothing of a row's counts towards the counts of all rows, for classes and for members.
PRIOR, MEMBER_PRIOR = 50.0, 50.0
#: Share of a row's own step that is taken while others add to it, at the start and in a round.
START, STEP = 0.7, 0.5
#: Bytes of text in a block, at once in the tokenizer, and for one part of the exchange.
BLOCK_BYTES, PIECE_BYTES, PART_BYTES = 3_000_000, 500_000, 64_000_000
END, END_CODE = 0x5BD1E9955BD1E995, 1
_CHUNK = 10_000
_DENSE = 1 << 14  # numbers of a summed array in one row
_SALTS = 4
_SPREAD = 4  # parts for each task that answers, so that hashing deals them evenly


#: The turn of a text that is held out.
HELD = 255


def turn(id_col: str = "doc_id") -> F.Column:
    """The gradient round that a text has part in. By crc32 of the id as text, a null id counting as empty text: where the
    remainder by 7 is 2 the text is held out, and the quotient gives the round of the others."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.when(crc % 7 == 2, HELD).otherwise(F.floor(crc / 7) % ROUNDS).cast("int")


def tokens(texts: list[bytes]):
    """Hashes of all tokens (each text's words and one end), where each text begins (one more), and the tokens' classes."""
    import numpy as np

    from quaymark.llm.shingles import mix, word_hashes

    h, at, code = word_hashes(texts, endings=True)
    h, code = np.insert(h, at[1:], np.uint64(END)), np.insert(code, at[1:], np.uint64(END_CODE))
    cls = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)) % np.uint64(CLASSES)
    return h, at + np.arange(len(at)), cls.astype(np.uint8)


def member_of(h):
    """Member of each word in its class."""
    import numpy as np

    return ((h >> np.uint64(20)) % np.uint64(MEMBERS)).astype(np.int64)


class Block:
    """Token numbers of some texts, the words they stand for, and contexts."""

    def __init__(self, begin, idx, vocab, cls, turn):
        import numpy as np

        self.begin, self.idx, self.vocab, self.held = begin, idx, vocab, turn == HELD
        none = len(vocab)
        self.one, two = np.full(len(idx), none, np.int32), np.full(len(idx), none, np.int32)
        self.one[1:], two[2:] = idx[:-1], idx[:-2]
        start = begin[:-1]
        second = start[begin[1:] - start > 1] + 1
        self.one[start] = two[start] = none
        two[second] = none
        wide = np.append(cls, np.uint8(CLASSES))
        self.cls, self.member = wide[idx], member_of(vocab).astype(np.uint8)[idx]
        one, two = wide[self.one], wide[two]
        self.row = one * np.uint16(CLASSES + 1) + two
        self.inner = self.cls * np.uint16(CLASSES + 1) + one
        self.turn = np.repeat(turn, np.diff(begin))
        self.train = self.turn != HELD

    def words_before(self, pos):
        """For each token the number of the word before among the words at pos, from 1; 0 for others."""
        import numpy as np

        place = np.zeros(len(self.vocab) + 1, np.int32)
        place[pos] = np.arange(1, len(pos) + 1)
        return place[self.one]


def class_probabilities(rows, one, row, first):
    """(tokens, CLASSES) by the weights of class contexts and of the words before."""
    import numpy as np

    x = rows[row]
    x += one[first]
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def expected_counts(block: Block, rows, one, first, use):
    """Sums of the class probabilities of the tokens in use, by class context and by word before."""
    import numpy as np

    by_row, by_word = np.zeros((len(rows), CLASSES), np.float32), np.zeros((len(one), CLASSES), np.float32)
    use = np.flatnonzero(use)
    use = use[np.argsort(block.row[use], kind="stable")]
    for lo in range(0, len(use), _CHUNK):
        t = use[lo : lo + _CHUNK]
        row, word = block.row[t], first[t]
        p = class_probabilities(rows, one, row, word)
        new = np.flatnonzero(np.diff(row.astype(np.int32), prepend=-1))
        by_row[row[new]] += np.add.reduceat(p, new)
        order = np.argsort(word, kind="stable")
        order = order[np.searchsorted(word[order], 1) :]
        if len(order):
            word = word[order]
            new = np.flatnonzero(np.diff(word, prepend=-1))
            by_word[word[new]] += np.add.reduceat(p[order], new)
    return by_row, by_word


def observed_counts(block: Block, keys, n: int, use):
    """What really followed each of n keys among the tokens in use."""
    import numpy as np

    return np.bincount(keys[use].astype(np.int64) * CLASSES + block.cls[use], minlength=n * CLASSES).reshape(-1, CLASSES)


def moved(weights, observed, expected, share):
    """Weights after a step towards the observed counts; rows without either stay."""
    import numpy as np

    return weights + STEP * np.log((observed + PRIOR * share) / (expected + PRIOR * share))


class Model:
    """share (classes), last (class before, classes), rows (class contexts, classes), skip (class before the last, classes), inner
    (log10, class and context, members), bucket (log10 of what its tokens and words add up to)."""

    def __init__(self, observed, inner_observed, bucket_tokens, bucket_words):
        import numpy as np

        n = bucket_tokens.reshape(CLASSES, MEMBERS) + 0.5
        self.share = n.sum(1) / n.sum()
        observed = observed.reshape(CLASSES + 1, CLASSES + 1, CLASSES)
        last = observed.sum(1)
        self.last = (last + PRIOR * self.share) / (last.sum(1, keepdims=True) + PRIOR)
        self.rows = np.log((observed + PRIOR * self.last[:, None]) / (observed.sum(2, keepdims=True) + PRIOR))
        self.skip = np.zeros((CLASSES + 1, CLASSES))
        inner = inner_observed.reshape(CLASSES, CLASSES + 1, MEMBERS)
        p = (n / n.sum(1, keepdims=True))[:, None]
        self.inner = np.log10((inner + MEMBER_PRIOR * p) / (inner.sum(2, keepdims=True) + MEMBER_PRIOR)).reshape(-1, MEMBERS)
        self.bucket = np.log10(bucket_tokens + bucket_words + 1.0)

    def learn(self, observed, expected) -> None:
        observed, expected = observed.reshape(self.rows.shape), expected.reshape(self.rows.shape)
        self.rows = moved(self.rows, observed, expected, self.share)
        self.skip = moved(self.skip, observed.sum(0), expected.sum(0), self.share)

    def light(self):
        """Weights of class contexts, in single precision; those of the skip feature are added in, as a context has one."""
        import numpy as np

        return (self.rows + self.skip).reshape(-1, CLASSES).astype(np.float32)

    def word_rows(self, observed, cls):
        """Weights that words of these classes start from."""
        import numpy as np

        base = self.last[cls]
        return START * np.log((observed + PRIOR * base) / ((observed.sum(1, keepdims=True) + PRIOR) * base))

    def log10(self, block: Block, counts, pos, one):
        """log10 probability of every token; counts of the block's words, weights of the words at pos."""
        import numpy as np

        first, rows, out = block.words_before(pos), self.light(), np.empty(len(block.idx))
        for lo in range(0, len(out), _CHUNK):
            s = slice(lo, lo + _CHUNK)
            p = class_probabilities(rows, one, block.row[s], first[s])
            out[s] = np.log10(p[np.arange(len(p)), block.cls[s]].astype(np.float64))
        out += self.inner[block.inner, block.member]
        return out + np.log10(counts[block.idx] + 1.0) - self.bucket[block.cls.astype(np.int32) * MEMBERS + block.member]


# --- blocks ---------------------------------------------------------------------------------------------------------------

_BLOCKS = "block long, ids binary, known binary, turn binary, begin binary, idx binary, vocab binary, cls binary, k int, part binary"


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs in blocks of about block_bytes of text; a longer text is a block of its own. The number of a block has that
    of its split in the upper bits. Rows without a block are pieces of arrays: the counts of class contexts and of members."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), turn(id_col).alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from quaymark.llm.minhash import cut

        number = TaskContext.get().partitionId() << 33
        parts, size, dense = [], 0, None
        kinds = [pa.int64(), *[pa.binary()] * 7, pa.int32(), pa.binary()]

        def flush():
            nonlocal dense
            h, cls = np.concatenate([p[2] for p in parts]), np.concatenate([p[4] for p in parts])
            begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
            vocab, at, idx = np.unique(h, return_index=True, return_inverse=True)
            # frequent words get small numbers
            order = np.argsort(-np.bincount(idx), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            vocab, cls, idx = vocab[order], cls[at[order]], place[idx]
            ids = [x for p in parts for x in p[0]]
            turns = np.array([x for p in parts for x in p[1]], np.uint8)
            b = Block(begin, idx, vocab, cls, turns)
            new = observed_counts(b, b.row, (CLASSES + 1) ** 2, b.train), np.bincount(b.inner[b.train].astype(np.int64) * MEMBERS + b.member[b.train], minlength=CLASSES * (CLASSES + 1) * MEMBERS)
            dense = new if dense is None else tuple(x + y for x, y in zip(dense, new))
            cols = np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids]), turns, begin, _planes(idx), vocab, cls
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)

        for batch in batches:
            for lo, hi, texts in cut(batch.column(2), min(PIECE_BYTES, block_bytes)):
                parts.append((batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), *tokens(texts)))
                size += sum(map(len, texts))
                if size >= block_bytes:
                    yield flush()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield flush()
        for x in _dense_rows(dense or (), number >> 33):
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((None,) * 8 + x, kinds)], names)

    return rows.mapInArrow(run, _BLOCKS)


def _planes(idx):
    """The bytes of 32-bit numbers, the lowest of all first: the upper ones are mostly zero and compress away."""
    return idx.astype("<i4").view("u1").reshape(-1, 4).T.copy()


def _numbers(data: bytes):
    import numpy as np

    return np.frombuffer(data, "u1").reshape(4, -1).T.copy().view("<i4").ravel()


def _read(row: dict) -> Block:
    import numpy as np

    get = lambda name, kind: np.frombuffer(row[name], kind)
    return Block(get("begin", np.int64), _numbers(row["idx"]), get("vocab", np.uint64), get("cls", np.uint8), get("turn", np.uint8))


def _dense_rows(arrays, salt: int):
    """(k, part) of the pieces of some arrays that aren't all zero."""
    import numpy as np

    for k, a in enumerate(arrays):
        a = a.ravel()
        for i in range(0, len(a), _DENSE):
            if (part := a[i : i + _DENSE]).any():
                yield (k * 1_000_000 + i // _DENSE) * _SALTS + salt % _SALTS, part.astype(np.float32).tobytes()


def _added(rows: DataFrame, shapes: list[int]):
    """Arrays of fixed sizes from rows (k, sums of that piece); the driver gets each piece at most _SALTS times."""
    import numpy as np

    out = [np.zeros(n) for n in shapes]
    for k, total in rows.collect():
        k //= _SALTS
        i, x = k % 1_000_000 * _DENSE, np.frombuffer(total)
        out[k // 1_000_000][i : i + len(x)] += x
    return out


def _summed(rows: DataFrame, shapes: list[int], at: str, name: str):
    """Arrays of fixed sizes from rows (k, part), added up in two steps."""
    import numpy as np

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(part.as_py(), np.float32).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "total"])

    some = rows.where("k is not null").select("k", "part").repartition(partitions(rows.sparkSession), "k")
    return _added(table(some.mapInArrow(add, "k int, total binary"), at, name), shapes)


def _dealt(h, parts: int):
    """(part, places in h) of the words that belong to each part."""
    import numpy as np

    part = h % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
    return [(int(part[order[i]]), order[i:j].astype(np.int32)) for i, j in zip(cuts, cuts[1:]) if j > i]


# --- the exchange ---------------------------------------------------------------------------------------------------------


def _answer(rows: DataFrame, at: str, name: str, tasks: int) -> str:
    """Writes answers (block, pid, ..) in a folder for each split of the corpus; rows without a block go to split -1."""
    path = f"{at}/{name}"
    named = rows.withColumn("split", F.coalesce(F.shiftright("block", 33), F.lit(-1)).cast("int"))
    with tidy(rows.sparkSession):
        named.repartition(tasks, "split", "pid").write.partitionBy("split").option("compression", "zstd").parquet(path)
    return path


def _beside(spark, path: str, schema: str) -> DataFrame:
    """The answers that belong to no block."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/split=-1")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/split=-1")


class _Answers:
    """The answers to a block, from the folders of its split. Keeps those of one split."""

    def __init__(self, *paths: str):
        self.paths, self.split, self.rows = paths, None, {}

    def __call__(self, block: int) -> list[dict]:
        from pyarrow import parquet

        from quaymark.llm.token_store import _fs

        if self.split != block >> 33:
            from pyarrow import default_memory_pool, fs

            self.split, self.rows = block >> 33, {}
            for path in self.paths:
                files, base = _fs(path)
                for f in files.get_file_info(fs.FileSelector(f"{base}/split={self.split}", allow_not_found=True)):
                    if f.path.endswith(".parquet"):
                        for r in parquet.ParquetFile(files.open_input_file(f.path)).read().to_pylist():
                            self.rows.setdefault(r["block"], []).append(r)
            default_memory_pool().release_unused()
        return self.rows.get(block, [])


def _rows(batches):
    """Rows one by one, so that what is made of a block is gone before the next is read."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _batch(rows, names, kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _count(blocks: DataFrame, parts: int, tasks: int, at: str) -> str:
    """Where the answers are: block, pos, c - counts of the words at pos of the block's words. Rows without a block have the tokens
    and words of buckets."""

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        names = ["pid", "block", "pos", "h", "n", "cls"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def one(row):
            b, cls = _read(row), np.frombuffer(row["cls"], np.uint8)
            n = np.bincount(b.idx[b.train], minlength=len(b.vocab)).astype(np.uint32)
            return _batch([(pid, row["block"], pos.tobytes(), b.vocab[pos].tobytes(), n[pos].tobytes(), cls[pos].tobytes()) for pid, pos in _dealt(b.vocab, parts)], names, kinds)

        for row in _rows(batches):
            yield one(row)

    asked = blocks.select("block", "turn", "begin", "idx", "vocab", "cls").mapInArrow(ask, "pid int, block long, pos binary, h binary, n binary, cls binary")

    def answer(batches):
        import numpy as np
        import pyarrow as pa

        rows, hs, ns, cs = [], [], [], []
        for batch in batches:
            rows += zip(batch.column("block").to_pylist(), batch.column("pos").to_pylist())
            for name, to, kind in (("h", hs, np.uint64), ("n", ns, np.uint32), ("cls", cs, np.uint8)):
                to += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
        if not rows:
            return
        u, first, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        c = np.bincount(inv, np.concatenate(ns), len(u)).astype(np.int64)
        seen = c > 0
        bucket = np.concatenate(cs)[first].astype(np.int64) * MEMBERS + member_of(u)
        stats = [np.bincount(bucket, c, CLASSES * MEMBERS).astype(np.int64).tolist(), np.bincount(bucket[seen], minlength=CLASSES * MEMBERS).tolist()]
        names, big = ["pid", "block", "pos", "c", "tokens", "words"], pa.list_(pa.int64())
        kinds, ends = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), big, big], np.cumsum([0, *map(len, hs)])
        for i, (block, pos) in enumerate(rows):
            yield _batch([(None, block, pos, c[inv[ends[i] : ends[i + 1]]].tobytes(), None, None)], names, kinds)
        yield _batch([(int(u[0] % np.uint64(parts)), None, None, None, *stats)], names, kinds)

    answers = asked.repartition(tasks, "pid").mapInArrow(answer, "pid int, block long, pos binary, c binary, tokens array<long>, words array<long>")
    return _answer(answers, at, "counts", tasks)


class _Weights(_Answers):
    """The weights that were sent to a split: hashes of words, ascending, and their rows in the bytes they were sent in."""

    def __call__(self, block: int):
        import numpy as np
        import zstandard

        if self.split != block >> 33:
            super().__call__(block)
            rows = [r for of in self.rows.values() for r in of]
            h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["h"], np.uint64) for r in rows)])
            unpack = zstandard.ZstdDecompressor().decompress
            w = np.concatenate([np.empty((0, 4 + CLASSES), np.int8), *(np.frombuffer(unpack(r["w"]), np.int8).reshape(-1, 4 + CLASSES) for r in rows)])
            self.h, at = np.unique(h, return_index=True)
            self.w, self.rows = w[at], {}
        return self.h, self.w

    def of(self, block: int, vocab) -> tuple:
        """(pos, place, one): which words of the vocabulary have weights, where they are among all of the split, and the weights;
        the first row of one is of words without weights."""
        import numpy as np

        h, w = self(block)
        place = np.searchsorted(h, vocab)
        has = np.append(h, np.uint64(0))[place] == vocab
        has[place == len(h)] = False
        pos, place = np.flatnonzero(has).astype(np.int32), place[has]
        one = np.zeros((len(pos) + 1, CLASSES), np.float32)
        one[1:] = _fine(w[place].tobytes())
        return pos, place, one


def _coarse(w) -> bytes:
    """Rows of weights, each in steps of a 127th of its largest."""
    import numpy as np

    top = np.maximum(np.abs(w).max(1), 1e-9).astype(np.float32)
    return np.hstack([top[:, None].view(np.int8), np.rint(w / top[:, None] * 127).astype(np.int8)]).tobytes()


def _fine(data: bytes):
    import numpy as np

    rows = np.frombuffer(data, np.int8).reshape(-1, 4 + CLASSES)
    return rows[:, :4].copy().view(np.float32) / 127 * rows[:, 4:]


def _counted(block: Block, replies):
    import numpy as np

    c = np.zeros(len(block.vocab), np.int64)
    for r in replies:
        if r.get("c") is not None:
            c[np.frombuffer(r["pos"], np.int32)] = np.frombuffer(r["c"], np.int64)
    return c


def _small(counts):
    """Whole counts in as few bytes as they need, with the number of bytes in front."""
    import numpy as np

    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint16 if counts.max() < 65_536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _large(data: bytes):
    import numpy as np

    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.float32).reshape(-1, CLASSES)


def _halved(x) -> tuple[bytes, bytes]:
    """(sums, shares) of rows; shares in half precision, whose range sums may leave."""
    import numpy as np

    total = x.sum(1, keepdims=True)
    return total.astype(np.float32).tobytes(), (x / np.maximum(total, 1e-30)).astype(np.float16).tobytes()


def _whole(sums: bytes, shares: bytes):
    import numpy as np

    return np.frombuffer(sums, np.float32)[:, None] * np.frombuffer(shares, np.float16).reshape(-1, CLASSES).astype(np.float32)


_SENT = "pid int, block long, h binary, want binary, cls binary, n binary, context binary, follow binary, full binary, o binary, sums binary, e binary, k int, part binary"
_STATE = "pid int, block long, h binary, w binary, k int, part binary"


class _Contexts:
    """Tokens of which only the class contexts are known."""

    def __init__(self, row):
        self.row = row


class _Split:
    """What a split gathers of its blocks, to be sent by words: tokens one by one, and rows of counts of words with weights."""

    def __init__(self):
        self.block, self.held = None, 0
        self.words: list[tuple] = []  # (hashes, classes, tokens in the next round)
        self.tokens: list[tuple] = []  # (word, class context, class)
        self.counts = None  # hashes of the words with weights, observed and expected counts

    def add(self, block: int, h, cls, ahead, word, context, follow) -> None:
        import numpy as np

        self.block = block if self.block is None else self.block
        before = sum(len(x[0]) for x in self.words)
        self.words.append((h, cls, ahead))
        self.tokens.append(((word + before).astype(np.int32), context, follow))
        self.held += len(word)

    def count(self, h, place, o, e) -> None:
        import numpy as np

        if self.counts is None:
            self.counts = h, np.zeros((len(h), CLASSES), np.uint32), np.zeros((len(h), CLASSES), np.float32)
        self.counts[1][place] += o.astype(np.uint32)
        self.counts[2][place] += e

    def messages(self, parts: int, start: bool, last: bool) -> list[tuple]:
        """Rows (pid, block, h, want, cls, n, context, follow, full, o, sums, e): for each word if its weights are wanted, and how
        many tokens follow one by one; full are the places of the words that have rows of counts."""
        import numpy as np

        h, cls, ahead = (np.concatenate(x) for x in zip(*self.words))
        self.words.clear()
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        part = (u % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        place = np.empty(len(u), np.int32)
        place[by] = np.arange(len(u), dtype=np.int32)
        inv = place[inv]
        want = np.ones(len(u), bool) if last else (np.bincount(inv, ahead, len(u)) > FEW)
        for i, x in enumerate(self.tokens):
            self.tokens[i] = inv[x[0]], *x[1:]
        word, context, follow = (np.concatenate(x) for x in zip(*self.tokens))
        self.tokens.clear()
        o, e, full = np.empty((0, CLASSES), np.uint32), None, np.empty(0, np.int32)
        if start:
            often = np.bincount(word, minlength=len(u)) > FEW
            full, row = np.flatnonzero(often), np.cumsum(often) - 1
            o, often = np.zeros(len(full) * CLASSES, np.int64), often[word]
            for lo in range(0, len(word), 1 << 18):
                s = slice(lo, lo + (1 << 18))
                o += np.bincount(row[word[s][often[s]]] * CLASSES + follow[s][often[s]], minlength=len(o))
            o = o.reshape(-1, CLASSES)
            word, context, follow = word[~often], context[~often], follow[~often]
        elif self.counts is not None:
            known, o, e = self.counts
            met = np.flatnonzero(e.any(1) | o.any(1))
            full = place[np.searchsorted(u, known[met])]
            sort = np.argsort(full)
            full, o, e = full[sort], o[met[sort]], e[met[sort]]
        sort = np.argsort(word, kind="stable")
        context, follow, n = context[sort], follow[sort], np.bincount(word, minlength=len(u))
        ends, u, cls, part = np.concatenate([[0], np.cumsum(n)]), u[by], cls[first[by]], part[by]
        cuts, out = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(u)], []
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                f, t = slice(*np.searchsorted(full, [i, j])), slice(ends[i], ends[j])
                sums, shares = (None, None) if e is None else _halved(e[f])
                out.append((int(part[i]), self.block, u[i:j].tobytes(), want[i:j].tobytes(), cls[i:j].tobytes() if start else None, _planes(n[i:j]).tobytes(), None if start else context[t].tobytes(), follow[t].tobytes(), _planes(full[f] - i).tobytes(), _small(o[f]), sums, shares))
        return out


def _learnt(blocks: DataFrame, counts: str, answers: str | None, state: DataFrame | None, model: Model, parts: int, tasks: int, at: str, r: int | None) -> tuple[str, DataFrame]:
    """(where the weights for the splits are, new state): the start from observed counts (r None) of words with LEAST tokens, or
    a gradient round. state holds the words of a part with their weights, a part's rows under its number."""
    spark, context = blocks.sparkSession, (CLASSES + 1) ** 2
    shared = spark.sparkContext.broadcast(model.light())  # class contexts, of fixed number
    after = 0 if r is None else r + 1

    def forward(batches):
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in _SENT.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 10, pa.int32(), pa.binary()]
        counted, sent, dense, split, gathered = _Answers(counts), _Weights(*([answers] if answers else [])), None, 0, _Split()

        def flush():
            nonlocal gathered
            rows, gathered = gathered.messages(parts, r is None, after == ROUNDS) if gathered.words else [], _Split()
            return _batch([(*x, None, None) for x in rows], names, kinds)

        def one(row):
            nonlocal dense
            b, cls = _read(row), np.frombuffer(row["cls"], np.uint8)
            own = np.flatnonzero(_counted(b, counted(row["block"])) >= LEAST).astype(np.int32)
            word, use = b.words_before(own), b.train if r is None else b.turn == r
            apart = use & (word > 0)
            if r is not None:
                pos, place, weights = sent.of(row["block"], b.vocab)
                first = b.words_before(pos)
                apart &= first == 0
                by_row, e = expected_counts(b, shared.value, weights, first, use & ~apart)
                new = observed_counts(b, b.row, context, use), by_row.astype(float)
                dense = new if dense is None else tuple(x + y for x, y in zip(dense, new))
                gathered.count(sent.h, place, observed_counts(b, first, len(pos) + 1, use)[1:], e[1:])
            ahead = np.bincount(word[b.turn == after], minlength=len(own) + 1)[1:]
            gathered.add(row["block"], b.vocab[own], cls[own], ahead, word[apart] - 1, b.row[apart], b.cls[apart])

        for row in _rows(batches):
            if gathered.words and (row["block"] >> 33 != split or gathered.held > HELD_BACK):
                yield flush()
            split = row["block"] >> 33
            one(row)
        yield flush()
        # pieces of arrays go to parts of their own
        yield _batch([(parts + k, *(None,) * 11, k, part) for k, part in _dense_rows(dense or (), split)], names, kinds)

    name = "start" if r is None else f"round-{r}"
    sent = blocks.select("block", "turn", "begin", "idx", "vocab", "cls").mapInArrow(forward, _SENT)
    start, share = model.word_rows, model.share

    def learn(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        import zstandard

        rows, old, sums, pack = [], [], {}, zstandard.ZstdCompressor(level=1).compress
        names, kinds = [x.split()[0] for x in _STATE.split(", ")], [pa.int32(), pa.int64(), *[pa.binary()] * 2, pa.int32(), pa.binary()]
        one = lambda *v: _batch([v], names, kinds)
        for batch in batches:
            for x in batch.to_pylist():
                if x["k"] is not None:
                    new = np.frombuffer(x["part"], np.float32).astype(np.float64)
                    sums[x["k"]] = sums[x["k"]] + new if x["k"] in sums else new
                elif x["block"] is None:
                    old.append((np.frombuffer(x["h"], np.uint64), np.frombuffer(x["w"], np.float32).reshape(-1, CLASSES)))
                else:
                    rows.append(x)
        for k, total in sums.items():
            yield one(k, None, None, None, k, total.astype(np.float32).tobytes())
        if not rows:
            return
        hs = [np.frombuffer(x["h"], np.uint64) for x in rows]
        u, at_first, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        ends = np.cumsum([0, *map(len, hs)])
        word = np.repeat(inv, np.concatenate([_numbers(x["n"]) for x in rows]))
        follow = np.frombuffer(b"".join(x["follow"] for x in rows), np.uint8)
        o, e = np.bincount(word * CLASSES + follow, minlength=len(u) * CLASSES).reshape(-1, CLASSES).astype(np.float32), None
        if r is not None:
            known = np.concatenate([x[0] for x in old])
            known_at = np.argsort(known)
            w = np.concatenate([x[1] for x in old])[known_at[np.searchsorted(known[known_at], u)]]
            weights = np.zeros((len(u) + 1, CLASSES), np.float32)
            weights[1:] = _fine(_coarse(w))  # as splits have them
            tokens = _Contexts(np.frombuffer(b"".join(x["context"] for x in rows), np.uint16))
            by_row, e = expected_counts(tokens, shared.value, weights, word + 1, np.ones(len(word), bool))
            e = e[1:]
            for k, part in _dense_rows((np.empty(0), by_row), TaskContext.get().partitionId()):
                yield one(k, None, None, None, k, part)
        for i, x in enumerate(rows):
            at_full = inv[ends[i] + _numbers(x["full"])]
            o[at_full] += _large(x["o"])
            if x["sums"] is not None:
                e[at_full] += _whole(x["sums"], x["e"])
        if r is None:
            w = start(o, np.frombuffer(b"".join(x["cls"] for x in rows), np.uint8)[at_first])
        else:
            w = moved(w, o, e, share)
        w = w.astype(np.float32)
        for i, x in enumerate(rows):
            wanted = np.frombuffer(x["want"], np.bool_)
            if wanted.any():
                yield one(None, x["block"], hs[i][wanted].tobytes(), pack(_coarse(w[inv[ends[i] : ends[i + 1]][wanted]])), None, None)
        for pid, of in _dealt(u, parts):
            for lo in range(0, len(of), 65_536):
                s = of[lo : lo + 65_536]
                yield one(pid, None, u[s].tobytes(), w[s].tobytes(), None, None)

    part = sent.withColumn("w", F.lit(None).cast("binary"))
    if state is not None:
        part = part.unionByName(state.select("pid", "block", "h", "w"), allowMissingColumns=True)
    path = _answer(part.repartition(tasks, "pid").mapInArrow(learn, _STATE), at, f"{name}-weights", tasks)
    beside = _beside(spark, path, _STATE)
    if r is not None:
        model.learn(*_summed(beside, [context * CLASSES] * 2, at, f"{name}-contexts"))
    return path, beside.where("h is not null")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null text is empty text and has one token, its end. Without training texts the base gives every token probability 1, as the
    one unknown word there is, and the model spreads it over its classes and members. Repeated rows are scored one by one
    and count one by one in training. An empty table gives an empty table.
    """
    import numpy as np

    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    read = table(make_blocks(docs, id_col, text_col, block_bytes), at, "blocks")
    observed, inner = _summed(read, [(CLASSES + 1) ** 2 * CLASSES, CLASSES * (CLASSES + 1) * MEMBERS], at, "contexts")
    blocks = read.where("block is not null")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("idx").cast("long")), F.lit(0))).head()[0]  # four bytes a token, about six of text
    tasks = max(partitions(spark), size * 6 // (PART_BYTES * 4))
    parts = tasks * _SPREAD
    counts = _count(blocks, parts, tasks, at)
    beside = _beside(spark, counts, "tokens array<long>, words array<long>")
    buckets = beside.select(F.posexplode(F.arrays_zip("tokens", "words")).alias("bucket", "x")).groupBy("bucket").agg(F.sum("x.tokens"), F.sum("x.words"))
    bucket_tokens, bucket_words = np.zeros(CLASSES * MEMBERS), np.zeros(CLASSES * MEMBERS)
    for b, t, w in buckets.collect():  # a row a bucket
        bucket_tokens[b], bucket_words[b] = t, w
    n_train, n_words = int(bucket_tokens.sum()), int(bucket_words.sum())
    model = Model(observed, inner, bucket_tokens, bucket_words)
    weights, state = _learnt(blocks, counts, None, None, model, parts, tasks, at, None)
    for r in range(ROUNDS):
        weights, state = _learnt(blocks, counts, weights, state, model, parts, tasks, at, r)
        drop(spark, at, f"round-{r - 1}-weights" if r else "start-weights")
    shared = spark.sparkContext.broadcast(model)  # class contexts and buckets, of fixed number

    def scored(batches):
        import pyarrow as pa

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        answer, sent = _Answers(counts), _Weights(weights)

        def one(row):
            b = _read(row)
            c = _counted(b, answer(row["block"]))
            pos, _, weights = sent.of(row["block"], b.vocab)
            lm = shared.value.log10(b, c, pos, weights)
            base = np.log10(c[b.idx] + 1.0) - np.log10(n_train + n_words + 1.0)
            sums = [np.add.reduceat(x, b.begin[:-1]) for x in ((c[b.idx] > 0).astype(np.int64), base, lm)]
            n = len(b.held)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], np.bool_))
            return pa.RecordBatch.from_arrays([ids, pa.array(b.held), pa.array(np.diff(b.begin)), pa.array(sums[0]), pa.array(np.full(n, n_train, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)

        for row in _rows(batches):
            yield one(row)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.drop("k", "part").mapInArrow(scored, schema)
