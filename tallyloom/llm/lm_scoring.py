"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to `order` long, with the counts of what follows each.
A symbol is predicted from the longest context; a context that hasn't seen it escapes to the next
shorter one, with probability distinct / (2 * total), each symbol seen giving half a count for that
(method D), and the symbols it has seen are excluded there. Below order 0 the symbols never seen are equally likely. A text is its bytes,
A-Z lower-cased, then an end symbol; contexts before its first byte hold a start symbol.

Pretrained: the trie's counts come from all training documents. Since P(symbol | context) depends
on the last `order` symbols only, the trie is kept as counts of (order + 1)-grams; every context of
order 2 and up shares its last two symbols with its grams, so tries under different pairs are
worked out apart, and only the table of pairs (at most 259**2 rows) goes to all tasks.
Scoring reads the texts once for each slice of the model; a slice has at most SLICE_KEYS keys, so
a task's memory is bounded whatever the model's size.

Adaptive: AdaptiveTrie learns from the very text it codes; adaptive() applies it by document.

Words are known by 64-bit hashes (bytewords); two of a million distinct words share one with a
probability of about 3e-8.

Defined results
  null or empty text   no words; the end symbol alone is scored
  null doc_id          counts as training (crc32 of the empty text); rows are kept
  repeated rows        each counts, each is scored
  empty table          no rows; without training documents the model is uniform
  very long text       one step of its own
  extra columns        ignored
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bytewords
from tallyloom.llm.common import materialize, partitions_for, read_table, shared_path, ship
from tallyloom.llm.store import read_file, write_file

ORDER = 5
END, START, BITS = 256, 257, 9
#: Keys (16 bytes each) of the model that a task holds at once.
SLICE_KEYS = 16_000_000
#: Distinct keys a task of the counting pass holds before it hands them on.
HELD_KEYS = 1_500_000
WORD, GRAM = 0, 1
_MODEL_SCHEMA = "kind int, key long, n long"


class AdaptiveTrie:
    """PPM in its plain form, symbol by symbol: counts by context, and coding that learns as it goes."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.seen: dict[tuple[int, ...], dict[int, int]] = defaultdict(dict)

    @staticmethod
    def symbols(text: str | None) -> list[int]:
        return [*(text or "").encode().translate(bytewords.LOWER.tobytes()), END]

    def log10_probability(self, context: tuple[int, ...], symbol: int) -> float:
        excluded: set[int] = set()
        out = 0.0
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[len(context) - k :], {})
            left = {s: c for s, c in counts.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                return out + log10((left[symbol] - 0.5) / total)
            out += log10(0.5 * len(left) / total)
            excluded |= left.keys()
        return out - log10(257 - len(excluded))

    def learn(self, context: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            counts = self.seen[context[len(context) - k :]]
            counts[symbol] = counts.get(symbol, 0) + 1

    def score(self, text: str | None, learn: bool = False) -> float:
        context, out = (START,) * self.order, 0.0
        for s in self.symbols(text):
            out += self.log10_probability(context, s)
            if learn:
                self.learn(context, s)
            context = (*context, s)[1:] if self.order else ()
        return out

    def train(self, text: str | None) -> None:
        context = (START,) * self.order
        for s in self.symbols(text):
            self.learn(context, s)
            context = (*context, s)[1:] if self.order else ()


def adaptive(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, code_length (bits): each text coded by a trie that starts empty and learns from it alone."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [-AdaptiveTrie(order).score(t, learn=True) / log10(2) for t in batch.column("_text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(bits, pa.float64())], names=["doc_id", "code_length"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").alias("_text")).mapInArrow(bytewords.tidy(run), f"doc_id {kind}, code_length double")


def _grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the (order + 1)-gram that ends at each symbol, its latest symbol lowest; which text's it is)."""
    base, n = int(offsets[0]), np.diff(offsets)
    own = np.repeat(np.arange(len(n)), n + 1)
    symbols = np.full(len(own), END, np.uint64)
    last = np.cumsum(n + 1) - 1
    inner = np.ones(len(own), bool)
    inner[last] = False
    symbols[inner] = bytewords.LOWER[raw[base : int(offsets[-1])]]
    first = last - n
    out = symbols.copy()
    for k in range(1, order + 1):
        before = np.empty_like(symbols)
        before[:k] = START
        before[k:] = symbols[: len(symbols) - k] if k else symbols
        for j in range(k):  # the j-th symbol of a text has only j before it
            at = first + j
            before[at[at <= last]] = START
        out |= before << np.uint64(BITS * k)
    return out, own


def _tally(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights (None: 1 each)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(keys))) if weights is None else np.add.reduceat(weights, new) if len(new) else weights
    return keys[new], sums


def _count(order: int):
    """Partial counts of words (of training texts) and grams (of all; those of other texts count 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], GRAM: []}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, n = _tally(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
                held[kind] = [(keys, n)]
                if len(keys) > HELD_KEYS:
                    yield from out(kind)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            for keys, n in held[kind]:
                yield pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])
            held[kind] = []

        for batch in batches:
            raw, offsets = bytewords.texts_of(batch.column("_text"))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in bytewords.steps(raw, offsets):
                words, text = bytewords.word_hashes(raw, offsets[a : b + 1])
                held[WORD].append(_tally(words[train[a:b][text]], None))
                grams, own = _grams(raw, offsets[a : b + 1], order)
                learned = train[a:b][own]
                held[GRAM].append(_tally(grams[learned], None))
                other = _tally(grams[~learned], None)[0]
                held[GRAM].append((other, np.zeros(len(other), np.int64)))
                for kind in (WORD, GRAM):
                    if sum(len(k) for k, _ in held[kind]) > HELD_KEYS:
                        yield from flush(kind)
        for kind in (WORD, GRAM):
            yield from flush(kind)
            yield from out(kind)

    return run


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at wanted keys; 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def gram_log10(grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 P(latest symbol | context) of each gram.

    grams: all that share their two latest context symbols with any of them, with training counts;
    pairs: the same of the grams of order 1, over the whole corpus.
    """
    trained = counts > 0
    keys, n = _tally(grams[trained], counts[trained])
    tables = {order: (keys, n)}
    for k in range(order - 1, -1, -1):
        if k == 1:
            keys, n = pairs  # whole at order 1 whatever this part holds
        keys, n = _tally(keys & np.uint64((1 << (BITS * (k + 1))) - 1), n)
        tables[k] = (keys, n)
    out, waits = np.zeros(len(grams)), np.ones(len(grams), bool)
    for k in range(order, -1, -1):
        mask, b = np.uint64((1 << (BITS * (k + 1))) - 1), np.uint64(BITS)
        keys, n = tables[k]
        total = _tally(keys >> b, n)
        kinds = _tally(keys >> b, None)
        here = grams & mask
        t, q = _look(*total, here >> b), _look(*kinds, here >> b)
        if k < order:  # without what the longer context has seen
            longer = tables[k + 1][0]
            seen = _tally(longer >> b, _look(keys, n, longer & mask))
            kinds = _tally(longer >> b, None)
            up = (grams & np.uint64((1 << (BITS * (k + 2))) - 1)) >> b
            t, q = t - _look(*seen, up), q - _look(*kinds, up)
        c = np.where(waits, _look(keys, n, here), 0)
        hit = c > 0
        out[hit] += np.log10((c[hit] - 0.5) / t[hit])
        escape = waits & ~hit & (q > 0)
        out[escape] += np.log10(0.5 * q[escape] / t[escape])
        waits &= ~hit
    out[waits] -= np.log10(257 - len(tables[0][0]))
    return out


def _work_out(pairs, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        grams, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(gram_log10(grams, n, pairs.value, order))], names=["key", "value"])

    return run


def _write_slice(root: str):
    """A slice's keys, sorted, and their values as one file of two arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("part", pa.int32()), ("key", pa.int64()), ("value", pa.float64())]))
        parts = table.column("part").to_numpy()
        keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        done = []
        for p in np.unique(parts).tolist():
            chosen = np.flatnonzero(parts == p)
            order = chosen[np.argsort(keys[chosen])]
            write_file(f"{root}/slice-{p:05d}", [keys[order].tobytes(), values[order].tobytes()])
            done.append(p)
        yield pa.record_batch([pa.array(done, pa.int32())], names=["part"])

    return run


@lru_cache(maxsize=2)
def _slice(path: str) -> tuple[np.ndarray, np.ndarray]:
    if path.startswith("file:"):  # mapped, not copied: a machine's workers share it
        data = np.memmap("/" + path.removeprefix("file:").lstrip("/"), np.uint64, "r")
    else:
        data = np.frombuffer(read_file(path), np.uint64)
    return data[: len(data) // 2], data[len(data) // 2 :].view(np.float64)


def _at(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a key is there, its value or 0). Distinct keys are looked up in order, so the mapped file is read in order."""
    keys, values = table
    distinct, back = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    hit = keys[at] == distinct
    return hit[back], np.where(hit, values[at], 0.0)[back]


def _score(words: str | None, grams: str | None, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytewords.texts_of(batch.column("_text"))
            n_words, n_known, word_log, gram_log = (np.zeros(batch.num_rows) for _ in range(4))
            for a, b in bytewords.steps(raw, offsets):
                hashes, text = bytewords.word_hashes(raw, offsets[a : b + 1])
                n_words[a:b] = np.bincount(text, minlength=b - a)
                if words and len(hashes):
                    hit, logs = _at(_slice(words), hashes)
                    n_known[a:b] = np.bincount(text, hit, b - a)
                    word_log[a:b] = np.bincount(text, logs, b - a)
                if grams:
                    g, own = _grams(raw, offsets[a : b + 1], order)
                    gram_log[a:b] = np.bincount(own, _at(_slice(grams), g)[1], b - a)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(n_words.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(word_log), pa.array(gram_log)], names=["doc_id", "held_out", "n_words", "n_known", "word_log", "gram_log"])

    return run


def _slices(table: DataFrame, name: str) -> list[str]:
    """Writes (key, value) as slices of at most about SLICE_KEYS keys; their paths."""
    spark = table.sparkSession
    n = table.count()
    if not n:
        return []
    many = partitions_for(n, SLICE_KEYS)
    root = shared_path(spark, name)
    # Sliced by a mix of the key, in an order that fits no other hash of it.
    parts = table.select(F.pmod(F.xxhash64(F.lit(name), "key"), F.lit(many)).cast("int").alias("part"), "key", "value").repartition(many, "part")
    done = parts.mapInArrow(bytewords.tidy(_write_slice(root)), "part int").collect()  # as many rows as slices
    return [f"{root}/slice-{r.part:05d}" for r in sorted(done)]


def score(documents: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Trains on the rows where held_out is false, and scores all. Columns as op2's, and code_bits."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select("doc_id", F.col("text").alias("_text"), held_out.alias("held_out"))
    partial = docs.select("_text", "held_out").mapInArrow(bytewords.tidy(_count(order)), _MODEL_SCHEMA)
    counts = materialize(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, grams = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == GRAM)
    texts = docs.where(~F.col("held_out")).count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = totals.n + texts, totals.v + (1 if texts else 0)
    two = F.col("key").bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
    found = grams.where("n > 0").groupBy(two.alias("key")).agg(F.sum("n").alias("n")).toPandas()  # at most 259**2 rows
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    sort = np.argsort(keys)
    pairs = spark.sparkContext.broadcast((keys[sort], found["n"].to_numpy(np.int64)[sort]))
    # Parts by the two latest context symbols.
    tasks = partitions_for(grams.count(), 500_000, 1)
    place = F.shiftright("key", BITS).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
    logs = grams.select("key", "n").repartition(tasks, place).mapInArrow(bytewords.tidy(_work_out(pairs, order)), "key long, value double")
    word_paths = _slices(words.select("key", F.log10(F.col("n") + 1).alias("value")), "words")
    gram_paths = _slices(logs, "grams")
    turns = max(len(word_paths), len(gram_paths), 1)
    at = lambda paths, i: paths[i] if i < len(paths) else None
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_words long, n_known long, word_log double, gram_log double"
    if turns == 1:
        sums = docs.mapInArrow(bytewords.tidy(_score(at(word_paths, 0), at(gram_paths, 0), order)), schema)
    else:
        numbered = materialize(docs.withColumn("doc_id_", F.col("doc_id")).withColumn("row", F.monotonically_increasing_id()), "rows").withColumn("doc_id", F.col("row"))
        each = [numbered.select("doc_id", "_text", "held_out").mapInArrow(bytewords.tidy(_score(at(word_paths, i), at(gram_paths, i), order)), schema.replace(f"doc_id {kind}", "doc_id long")) for i in range(turns)]
        sums = each[0]
        for x in each[1:]:
            sums = sums.union(x)
        sums = sums.groupBy("doc_id", "held_out").agg(F.max("n_words").alias("n_words"), *(F.sum(c).alias(c) for c in ("n_known", "word_log", "gram_log")))
        sums = sums.join(numbered.select("row", F.col("doc_id_").alias("id")), F.col("doc_id") == F.col("row")).drop("doc_id", "row").withColumnRenamed("id", "doc_id")
    end_known = 1 if texts else 0
    return sums.select(
        "doc_id", "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + end_known).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("word_log") + F.lit(log10(texts + 1)) - (F.col("n_words") + 1) * F.lit(log10(n_train + v_train + 1))).alias("base_score"),
        F.col("gram_log").alias("score"),
        (-F.col("gram_log") / F.lit(log10(2))).alias("code_bits"),
    )


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(read_table(spark, sf_dir, "documents"), held_out)
