"""Operator 4: a hidden Markov language model, trained by Baum-Welch and scored by the exact forward recursion.

Tokens are words and one end for each document. The hidden states emit symbols: every word that was seen ``min_count``
times is a symbol of its own, as are the ``n_words`` most frequent ones in any case; every other word belongs to a
symbol for its last letters, and the end is a symbol. Given its symbol, a word has its add-one probability among the
words of that symbol, with one place for all unseen words, so text probabilities add up to one. The alphabet grows with
the corpus, up to the two bytes of a symbol; all counts come from all training documents.

1. Each task numbers the distinct words of its rows and writes its documents as these numbers, with the words.
2. Word counts are sums over the tasks' distinct words; counts go back to each task's words by a join on the word.
3. Documents meet the counts of their task's words and become symbol strings with their unigram sums.
4. In each Baum-Welch round tasks add up expected counts for their documents by scaled forward-backward recursion;
   Spark adds them over all tasks; the driver gets one row for each symbol and state.
5. The forward recursion over the whole symbol string gives the document's probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

END = b" "  # no word holds a space
SPLIT = 400_000  # a task starts a new numbering after so many distinct words,
PART_TOKENS = 16_000_000  # or so many tokens: a part's documents and words are one frame of the join
MOST_SYMBOLS = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Documents to leave out of training: crc32 of the id as text, mod 7, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: small numbers make planes that compress to little."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _numbered(docs: DataFrame) -> DataFrame:
    """Document rows (doc_id, held_out, planes) and word rows (word, local, n: count in training rows), by part."""
    schema = "part long, doc_id long, held_out boolean, planes binary, word binary, local int, n long"
    most_words, most_tokens = SPLIT, PART_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        index: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)

        def rows(size: int, part: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"part": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "planes": pa.binary(), "word": pa.binary(), "local": pa.int32(), "n": pa.int64()}
            given["part"] = pa.array(np.full(size, part, dtype=np.int64))
            return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(size, t)) for k, t in kinds.items()], list(kinds))

        def words() -> Iterator[pa.RecordBatch]:
            nonlocal index, counts, serial
            listed = list(index)
            for at in range(0, len(listed), 20_000):
                own = listed[at : at + 20_000]
                yield rows(len(own), (task << 32) + serial, word=pa.array(own, pa.binary()), local=pa.array(np.arange(at, at + len(own), dtype=np.int32)), n=pa.array(counts[at : at + len(own)]))
            index, counts, serial = {}, np.zeros(0, np.int64), serial + 1

        tokens_here = 0
        for batch in batches:
            texts, left_out = batch.column("text").cast(pa.large_binary()), batch.column("held_out").to_pylist()
            begin = 0
            while begin < batch.num_rows:
                out, train, end = [], [], begin
                # up to 500 documents, fewer where the numbering is full
                while end < batch.num_rows and end < begin + 500 and len(index) <= most_words and tokens_here <= most_tokens:
                    tokens = [*texts[end].as_py().lower().split(), END]
                    for t in tokens:
                        if t not in index:
                            index[t] = len(index)
                    numbers = np.fromiter(map(index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                    tokens_here += len(tokens)
                    out.append(_planes(numbers))
                    if not left_out[end]:
                        train.append(numbers)
                    end += 1
                counts = np.concatenate((counts, np.zeros(len(index) - len(counts), np.int64)))
                if train:
                    counts += np.bincount(np.concatenate(train), minlength=len(index))
                part = batch.slice(begin, end - begin)
                yield rows(part.num_rows, (task << 32) + serial, doc_id=part.column("doc_id"), held_out=part.column("held_out"), planes=pa.array(out, pa.binary()))
                begin = end
                if len(index) > most_words or tokens_here > most_tokens:
                    yield from words()
                    tokens_here = 0
        yield from words()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, schema)


def _class_of(word: bytes, n_words: int, n_endings: int) -> int:
    return n_words + zlib.crc32(word[-3:]) % n_endings


class Model:
    """A hidden Markov model over a fixed alphabet: start (K), move (K x K), emit (symbols x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first_guess(cls, weights: np.ndarray, states: int, seed: int = 7) -> Model:
        """States that stay, and emit each symbol about as often as it occurs."""
        noise = np.random.default_rng(seed).gamma(1.0, 1.0, (len(weights), states)) + 0.05
        emit = noise * weights[:, None]
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def _batches(self, strings: list[np.ndarray], most: int = 400_000) -> Iterator[list[int]]:
        """Strings of like length together, longest first."""
        batch: list[int] = []
        total = 0
        for k in sorted(range(len(strings)), key=lambda k: -len(strings[k])):
            if batch and (total + len(strings[k]) > most or len(strings[k]) < 0.5 * len(strings[batch[0]]) and total > most // 16):
                yield batch
                batch, total = [], 0
            batch.append(k)
            total += len(strings[k])
        if batch:
            yield batch

    def _forward(self, strings: list[np.ndarray], keep: bool) -> tuple:
        """Scaled forward recursion over strings sorted longest first; time runs down, strings run across."""
        lengths = np.array([len(x) for x in strings])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # strings longer than t
        at = np.concatenate(([0], np.cumsum(alive)))
        symbols = np.empty(at[-1], dtype=np.int64)
        for k, x in enumerate(strings):
            symbols[at[: len(x)] + k] = x
        emitted = self.emit[symbols]
        log = np.zeros(len(strings))
        scales = np.empty(at[-1])
        forward = np.empty((at[-1], len(self.start))) if keep else None
        state = np.tile(self.start, (len(strings), 1))
        for t in range(lengths[0]):
            a, b = at[t], at[t + 1]
            state = (state[: b - a] @ self.move if t else state) * emitted[a:b]
            scale = state.sum(1)
            state /= scale[:, None]
            scales[a:b] = scale
            if keep:
                forward[a:b] = state
        logs = np.log(scales)
        for t in range(lengths[0]):
            log[: at[t + 1] - at[t]] += logs[at[t] : at[t + 1]]
        return log, at, symbols, emitted, scales, forward

    def log_likelihood(self, strings: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each string's probability; strings are not empty."""
        out = np.zeros(len(strings))
        for batch in self._batches(strings):
            out[batch] = self._forward([strings[k] for k in batch], keep=False)[0]
        return out

    def expected(self, strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of all strings, and their log-likelihood."""
        states = len(self.start)
        starts, moves, emissions, total = np.zeros(states), np.zeros((states, states)), np.zeros_like(self.emit), 0.0
        for batch in self._batches(strings):
            log, at, symbols, emitted, scales, forward = self._forward([strings[k] for k in batch], keep=True)
            total += log.sum()
            emitted /= scales[:, None]
            back = np.ones((0, states))
            posterior = np.empty_like(forward)
            for t in range(len(at) - 2, -1, -1):
                a, b = at[t], at[t + 1]
                now = np.ones((b - a, states))
                if len(back):
                    seen = emitted[b : at[t + 2]] * back
                    moves += forward[a : a + len(seen)].T @ seen
                    now[: len(seen)] = seen @ self.move.T
                posterior[a:b] = forward[a:b] * now
                back = now
            starts += posterior[: at[1]].sum(0)
            for k in range(states):
                emissions[:, k] += np.bincount(symbols, weights=posterior[:, k], minlength=len(self.emit))
        return starts, moves * self.move, emissions, total

    def improved(self, starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, weights: np.ndarray) -> Model:
        """The next model from expected counts; a little of the symbols' overall share keeps all of them possible."""
        emit = emissions + 0.5 * weights[:, None]
        return Model((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def _strings(batches: Iterator[pa.RecordBatch], most: int = 6_000_000) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows gathered up to ``most`` symbols, so that strings of like length can go together."""
    rows, strings, total = [], [], 0
    for batch in batches:
        rows.append(batch)
        own = [np.frombuffer(x, "<u2") for x in batch.column("symbols").to_pylist()]
        strings += own
        total += sum(map(len, own))
        if total > most:
            yield rows, strings
            rows, strings, total = [], [], 0
    if rows:
        yield rows, strings


def baum_welch(encoded: DataFrame, model: Model, weights: np.ndarray, rounds: int) -> Model:
    """``rounds`` rounds over the ``symbols`` of all rows of ``encoded``."""
    states = len(model.start)
    spark = encoded.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: list | None = None
            for _, strings in _strings(batches):
                got = shared.value.expected(strings)
                sums = list(got) if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
            if sums is not None:
                rows = np.concatenate((sums[2], sums[1], sums[0][None, :]))  # emissions, then moves, then starts
                used = np.flatnonzero(rows.sum(1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[used, k]) for k in range(states))], ["slot", *(f"s{k}" for k in range(states))])

        schema = "slot int, " + ", ".join(f"s{k} double" for k in range(states))
        sums = encoded.select("symbols").mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect()
        rows = np.zeros((len(weights) + states + 1, states))
        for r in sums:  # one for each symbol and state
            rows[r[0]] = r[1:]
        model = model.improved(rows[-1], rows[len(weights) : -1], rows[: len(weights)], weights)
    return model


def score_texts(docs: DataFrame, states: int = 8, rounds: int = 4, n_words: int = 4096, n_endings: int = 4096, min_count: int = 20_000) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model learnt from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram, log10) and score (log10
    probability of the whole text under the hidden Markov model). Null or empty text is one end token. Equal rows are
    trained on and scored one by one. A null doc_id counts as the id "". Without training rows all words are unseen.
    Words seen ``min_count`` times have symbols of their own, the ``n_words`` most frequent anyhow (the end is one).
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = materialise(_numbered(docs), "numbered")
    words = table.where("word is not null").select("part", "word", "local", "n")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "counts").where("c > 0")
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_types = int(totals[0] or 0), int(totals[1])
    n_words = min(max(n_words, counts.where(F.col("c") >= min_count).count() + 1), MOST_SYMBOLS - n_endings)
    top = [bytes(r[0]) for r in counts.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("c"), "word").limit(n_words - 1).select("word").collect()]
    number = {w: k for k, w in enumerate(top)} | {END: n_words - 1}
    known = spark.sparkContext.broadcast(number)

    def symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [known.value.get(w, -1) for w in batch.column("word").to_pylist()]
            own = [_class_of(w, n_words, n_endings) if s < 0 else s for w, s in zip(batch.column("word").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "symbol"])

    by_symbol = counts.mapInArrow(symbol, "word binary, c long, symbol int").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    size = n_words + n_endings
    mass, kinds = np.zeros(size), np.zeros(size)
    for r in by_symbol:  # one for each symbol
        mass[r[0]], kinds[r[0]] = r[1], r[2]
    weights = (mass + 1) / (mass + 1).sum()
    room = spark.sparkContext.broadcast(np.where(np.arange(size) < n_words, 1.0, mass + kinds + 1))

    local = words.select("part", "word", "local").join(counts, "word", "left").select("part", "word", "local", F.coalesce("c", F.lit(0)).alias("c"))
    local = local.mapInArrow(symbol, "part long, word binary, local int, c long, symbol int").select("part", "local", "c", "symbol")
    strings = table.where("planes is not null").select("part", "doc_id", "held_out", "planes")

    def look_up(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n = len(found)
        c, symbols = np.zeros(n), np.zeros(n, dtype=np.int64)
        c[found["local"]], symbols[found["local"]] = found["c"], found["symbol"]
        base = np.log10((c + 1) / (n_all + n_types + 1))
        inner = np.where(symbols < n_words, 0.0, np.log10((c + 1) / room.value[symbols]))
        rows = []
        for planes in texts["planes"]:
            x = _numbers(planes)
            rows.append((len(x), int((c[x] > 0).sum()), float(base[x].sum()), float(inner[x].sum()), symbols[x].astype("<u2").tobytes()))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "inner", "symbols"])
        return pd.concat([texts[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, symbols binary"
    encoded = materialise(strings.groupBy("part").cogroup(local.groupBy("part")).applyInPandas(look_up, schema), "symbols")
    model = baum_welch(encoded.where("not held_out"), Model.first_guess(weights, states), weights, rounds)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, strings in _strings(batches):
            logs = final.value.log_likelihood(strings) / np.log(10)
            at = 0
            for batch in rows:
                own = logs[at : at + batch.num_rows] + batch.column("inner").to_numpy()
                at += batch.num_rows
                names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(own)], [*names, "score"])

    scored = encoded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
