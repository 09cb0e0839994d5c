"""Language identification word by word with a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and whether a lexicon of each language has it; their weights
and the transitions between the labels of successive words are learnt together. Forward-backward over a whole text gives
every word's posterior, so a text that switches language is labelled piece by piece; a text's language is the label with
the largest share of them, and that share is its score.

The model is trained on the driver from a bounded sample: PER_LANGUAGE labelled texts of each language, those with the
smallest hashes of their ids, of which PIECE characters at most from a place that the hash names, and SEQUENCES word
sequences that are put together from pieces of them, with switches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[^\W\d_]+")
PER_LANGUAGE, PIECE, SEQUENCES, LENGTH = 300, 20_000, 1500, 48
ROWS = 1 << 16
ITERATIONS, RATE, DECAY = 40, 0.5, 1e-4
#: Words with at least this many occurrences in the sample enter the lexicon.
LEXICON_LEAST = 3
STRIDE, REMEMBERED, BATCH_WORDS = 128, 250_000, 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters. Signs that only count as word characters, like one half or Roman numerals, are no letters."""
    found = WORDS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed rows of a lower-case word's features."""
    w = f"^{word}$"
    names = ["b", *("p" + word[:i] for i in (1, 2, 3)), *("s" + word[-i:] for i in (1, 2, 3))]
    names += [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    if word in lexicon:
        names.append(f"#{lexicon[word]}")
    return [zlib.crc32(x.encode("utf-8", "replace")) % ROWS for x in names]


class Chain:
    """Weights (ROWS, labels), transitions (labels, labels), labels and lexicon (word: bits of the languages that have it)."""

    def __init__(self, labels, weights, transitions, lexicon):
        self.labels, self.weights, self.transitions, self.lexicon = labels, weights, transitions, lexicon

    def scores(self, words: list[str]):
        """(words, labels) emission scores."""
        import numpy as np

        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        rows = [word_features(w, self.lexicon) for w in words]
        flat = np.fromiter((x for r in rows for x in r), np.int64)
        at = np.cumsum([0] + [len(r) for r in rows[:-1]])
        return np.add.reduceat(self.weights[flat], at).astype(np.float32)


def forward_backward(emissions, lengths, transitions, stride: int = STRIDE):
    """Posteriors (words, labels) of sequences that stand one after the other in emissions; none is empty.

    Long sequences are cut into rows of `stride` words. The product of a row's matrices carries the chain from one row to
    the next, so all rows advance together and the result is exact for the whole sequence.
    """
    import numpy as np

    n_lab = emissions.shape[1]
    lengths = np.asarray(lengths)
    per = -(-lengths // stride)
    rows = int(per.sum())
    first = np.cumsum(per) - per
    seq_at = np.cumsum(lengths) - lengths
    word_row = np.repeat(first, lengths) + (np.arange(len(emissions)) - np.repeat(seq_at, lengths)) // stride
    word_col = (np.arange(len(emissions)) - np.repeat(seq_at, lengths)) % stride
    e = np.ones((rows, stride, n_lab))
    e[word_row, word_col] = np.exp(emissions - emissions.max(1, keepdims=True))
    used = np.bincount(word_row, minlength=rows)
    t = np.exp(transitions - transitions.max())
    start = np.zeros(rows, bool)
    start[first] = True
    product = np.tile(np.eye(n_lab), (rows, 1, 1))
    steps = int(used.max())
    for c in range(steps):
        new = product @ t * e[:, c, None, :]
        if c == 0:
            new[start] = np.eye(n_lab) * e[start, 0, None, :]
        new /= new.sum((1, 2), keepdims=True)
        live = c < used
        product[live] = new[live]
    into, out = np.ones((rows, n_lab)), np.ones((rows, n_lab))
    order = np.argsort(-per, kind="stable")
    for k in range(1, int(per.max())):
        live = first[order[: int((per > k).sum())]] + k
        v = np.einsum("ri,rij->rj", into[live - 1], product[live - 1])
        into[live] = v / v.sum(1, keepdims=True)
    for k in range(int(per.max()) - 1, 0, -1):
        live = first[order[: int((per > k).sum())]] + k
        v = np.einsum("rij,rj->ri", product[live], out[live])
        out[live - 1] = v / v.sum(1, keepdims=True)
    alpha = np.empty((rows, stride, n_lab))
    a = into
    for c in range(steps):
        new = (a @ t) * e[:, c]
        if c == 0:
            new[start] = into[start] * e[start, 0]
        a = np.where((c < used)[:, None], new / new.sum(1, keepdims=True), a)
        alpha[:, c] = a
    b = out
    for c in range(steps - 1, -1, -1):
        p = alpha[:, c] * b
        alpha[:, c] = p / p.sum(1, keepdims=True)
        new = (b * e[:, c]) @ t.T
        b = np.where((c < used)[:, None], new / new.sum(1, keepdims=True), b)
    return alpha[word_row, word_col]


def expectations(em, trans):
    """Of sequences of one length with scores em (sequence, place, label): posteriors, and expected transitions in all."""
    import numpy as np

    e = np.exp(em - em.max(2, keepdims=True))
    t = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for c in range(1, e.shape[1]):
        v = (alpha[:, c - 1] @ t) * e[:, c]
        alpha[:, c] = v / v.sum(1, keepdims=True)
    for c in range(e.shape[1] - 2, -1, -1):
        v = (beta[:, c + 1] * e[:, c + 1]) @ t.T
        beta[:, c] = v / v.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * t * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post, pair.sum((0, 1))


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Chain:
    """texts: (text, language). Gradient ascent on the likelihood of sequences with switches."""
    import numpy as np

    rng = np.random.default_rng(seed)
    by: dict[str, list[list[str]]] = defaultdict(list)
    for text, lang in texts:
        if words := words_of(text.lower()):
            by[lang].append(words)
    labels = sorted(by)
    if not labels:
        return Chain([], np.zeros((ROWS, 0), np.float32), np.zeros((0, 0)), {})
    counts = {g: Counter(w for ws in by[g] for w in ws) for g in labels}
    lexicon: dict[str, int] = {}
    for i, g in enumerate(labels):
        for w, c in counts[g].items():
            if c >= LEXICON_LEAST:
                lexicon[w] = lexicon.get(w, 0) | 1 << i
    n_lab = len(labels)
    vocab: dict[str, int] = {}
    x, y = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        c = 0
        while c < LENGTH:
            g = int(rng.integers(n_lab))
            ws = by[labels[g]][int(rng.integers(len(by[labels[g]])))]
            k = min(LENGTH - c, int(rng.integers(6, LENGTH)), len(ws))
            at = int(rng.integers(len(ws) - k + 1))
            for w in ws[at : at + k]:
                x[s, c], y[s, c] = vocab.setdefault(w, len(vocab)), g
                c += 1
    rows = [word_features(w, lexicon) for w in vocab]
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    sizes = np.array([len(r) for r in rows])
    at, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    weights, trans = np.zeros((ROWS, n_lab)), np.zeros((n_lab, n_lab))
    gw, gt = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    gold_trans = np.zeros((n_lab, n_lab))
    np.add.at(gold_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(ITERATIONS):
        post, pairs = expectations(np.add.reduceat(weights[flat], at)[x], trans)
        grad = -post
        np.put_along_axis(grad, y[:, :, None], np.take_along_axis(grad, y[:, :, None], 2) + 1, 2)
        by_word = np.stack([np.bincount(x.ravel(), grad[:, :, i].ravel(), len(rows)) for i in range(n_lab)], 1)
        g = np.stack([np.bincount(flat, by_word[owner, i], ROWS) for i in range(n_lab)], 1) / SEQUENCES - DECAY * weights
        gw += g * g
        weights += RATE * g / np.sqrt(gw)
        h = (gold_trans - pairs) / SEQUENCES - DECAY * trans
        gt += h * h
        trans += 0.2 * h / np.sqrt(gt)
    return Chain(labels, weights.astype(np.float32), trans, lexicon)


def training_fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Chain:
    """Fits on the bounded sample of rows with a language outside the held-out fold."""
    good = docs.where((training_fold(id_col) != 2) & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in good.groupBy(F.col(lang_col)).count().collect()}  # a row a language
    if not sizes:
        return fit([])
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, min(1 << 30, int((1 << 30) * 2.0 * PER_LANGUAGE / n)))])
    few = good.where(h <= bound[F.col(lang_col)]).select(F.col(lang_col).alias("g"), h.alias("h"), F.col(text_col).alias("t")).where("t is not null")
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - PIECE, F.lit(0)) + 1) + 1
    # a row a hash, so an id that many rows repeat counts once
    picked = few.select("g", "h", F.substring("t", start.cast("int"), PIECE).alias("t")).groupBy("g", "h").agg(F.min("t").alias("t")).collect()
    by: dict[str, list] = defaultdict(list)
    for r in sorted(picked, key=lambda r: (r["g"], r["h"], r["t"])):
        if len(by[r["g"]]) < PER_LANGUAGE:
            by[r["g"]].append((r["t"], r["g"]))
    return fit([x for g in sorted(by) for x in by[g]])


def identify(docs: DataFrame, model: Chain, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """keep columns of every row with lang_pred, score, lang_shares (posterior share of each label, in label order).

    und with score 0 where the text is null or has no letter, or where nothing was there to learn from. prefix goes before
    the three names, for docs that have columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS by labels, bounded by the sample
    added = [f"{prefix}{n}" for n in ("lang_pred", "score", "lang_shares")]
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.DoubleType()))
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])
    cols = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        memory: dict[str, int] = {}
        table = np.zeros((1024, len(m.labels)), np.float32)
        for batch in batches:
            texts = batch.column(at)
            lo = 0
            while lo < len(texts):
                hi, words, counts = lo, [], []
                while hi < len(texts) and len(words) < BATCH_WORDS:
                    ws = words_of((texts[hi].as_py() or "").lower())
                    words += ws
                    counts.append(len(ws) if m.labels else 0)
                    hi += 1
                some = [c for c in counts if c]
                pred, score, shares = ["und"] * (hi - lo), [0.0] * (hi - lo), [[] for _ in range(hi - lo)]
                if some:
                    if len(memory) > REMEMBERED:
                        memory.clear()
                    new = [w for w in dict.fromkeys(words) if w not in memory]
                    if len(memory) + len(new) > len(table):
                        grown = np.zeros((2 * (len(memory) + len(new)), table.shape[1]), np.float32)
                        grown[: len(table)] = table
                        table = grown
                    table[len(memory) : len(memory) + len(new)] = m.scores(new)
                    memory.update(zip(new, range(len(memory), len(memory) + len(new))))
                    post = forward_backward(table[np.fromiter(map(memory.__getitem__, words), np.int64, len(words))], some, m.transitions)
                    sums = np.add.reduceat(post, np.cumsum([0] + some[:-1])) / np.array(some)[:, None]
                    best = sums.argmax(1)
                    for i, k in enumerate(i for i, c in enumerate(counts) if c):
                        pred[k], score[k], shares[k] = m.labels[best[i]], float(min(1.0, sums[i, best[i]])), sums[i].tolist()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(pred), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], [*keep, *added])
                lo = hi

    return cols.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on docs and labels every row: doc_id, held_out, lang_pred, score. Repeated rows get the same result each."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (training_fold(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
