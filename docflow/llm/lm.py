"""A gated recurrent language model, trained and applied in numpy inside Spark tasks, and add-one word counts."""

from __future__ import annotations

import heapq
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import held, tabled, with_row_key
from docflow.llm.words import PIECE_BYTES, by_bytes, give_back, mix, split_words, stretches, strings, sums, thrifty, word_codes

#: Words with an output of their own, and how many share a class; all others are one of `TAIL` kinds of rare word.
WORDS, CLASS_WORDS, TAIL = 2048, 64, 16
HIDDEN, INPUT = 32, 24
#: Streams of text trained side by side, steps that errors go back, and streams scored side by side.
STREAMS, WINDOW, SCORED = 128, 32, 512
#: Tokens that a step of training rests on at least.
STEP = 128
#: Rounds of training, each over its share of the training documents, dealt by a hash of their rows; together they are all.
ROUNDS = 2
#: Step size, and steps that it takes to get there; over the texts that are trained on together it falls to a tenth.
RATE, WARM = 0.015, 20
#: Text that is trained on and scored together: long texts are laid beside so many others.
CHUNK_BYTES, SLICE_BYTES = 24 << 20, 16 << 20
#: Tokens, about, whose places are made together.
PLACED = 1 << 18
#: Weights that are updated together.
BLOCK = 1 << 14
#: Places of one word whose errors are summed in a call of their own; fewer are summed for all words at once.
OFTEN = 16
#: Scored tokens, about, whose outputs are made together.
OUTPUTS = 1 << 13
#: Text whose words are counted in one task.
BUCKET_BYTES = 32 << 20
#: Sets of weights that are averaged in one task.
FAN_IN = 32
END = "\n"
#: Four times the class of a length, and which bytes are punctuation.
OF_LENGTH, PUNCTUATION = np.searchsorted([5, 9, 13], np.arange(14), "right") * 4, np.isin(np.arange(256), list(string.punctuation.encode()))


def kinds(words: pa.Array) -> np.ndarray:
    """Kind of rare word, of a byte at least: by length, whether it is all ASCII, and whether it ends in punctuation."""
    if not len(words):
        return np.zeros(0, np.int64)
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    last = np.frombuffer(words.buffers()[2], np.uint8)[places[1:] - 1]
    length = np.asarray(pc.utf8_length(words))
    return OF_LENGTH[np.minimum(length, len(OF_LENGTH) - 1)] + (length == np.diff(places)) * 2 + PUNCTUATION[last]


@dataclass
class Vocabulary:
    """The most frequent training words, and what rare words of each kind weigh: the sum of their counts plus one."""

    words: list[str]
    counts: np.ndarray
    tail_counts: np.ndarray
    tail_weight: np.ndarray
    tokens: int
    distinct: int

    def ids(self, words: pa.Array) -> np.ndarray:
        """Output of each word: first the kinds of rare words, then the frequent ones."""
        found = np.array(pc.fill_null(pc.index_in(words, pa.array(self.words, words.type)), -1), np.int32)
        rare = found < 0
        found += TAIL
        found[rare] = kinds(words.filter(pa.array(rare)))
        return found

    def plain(self) -> tuple:
        """What the vocabulary is made from, for broadcasts: executors need not know this package to unpack it."""
        return self.words, self.counts, self.tail_counts, self.tail_weight, self.tokens, self.distinct

    @property
    def end(self) -> int:
        return TAIL + self.words.index(END) if END in self.words else 0

    @property
    def class_of(self) -> np.ndarray:
        return np.concatenate([np.zeros(TAIL, np.int64), 1 + np.arange(len(self.words)) // CLASS_WORDS])


class Model:
    """Gated recurrent units over embedded words; the next word's class and, within it, the word are two softmaxes."""

    def __init__(self, vocabulary: Vocabulary, weights: list[np.ndarray] | None = None):
        self.vocabulary, self.trained, n = vocabulary, 0, TAIL + len(vocabulary.words)
        self.steps, self.moments, self._spaces = 0, None, {}
        self.class_of = vocabulary.class_of
        self.bounds = np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 2))
        if weights is None:
            source = np.random.default_rng(7)
            draw = lambda *shape: (source.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
            seen = np.concatenate([vocabulary.tail_counts, vocabulary.counts]).astype(np.float64) + 0.5
            mass = np.add.reduceat(seen, self.bounds[:-1])
            weights = [draw(n, INPUT) * 4, draw(INPUT, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32),
                       np.zeros((HIDDEN, len(mass)), np.float32), np.log(mass / mass.sum()).astype(np.float32),
                       np.zeros((HIDDEN, n), np.float32), np.log(seen / mass[self.class_of]).astype(np.float32)]
        self.weights = weights

    def inputs(self) -> np.ndarray:
        """What each word adds to the gates."""
        embedded, x, _, bias, *_ = self.weights
        return embedded @ x + bias

    def _by_gate(self, words: np.ndarray) -> np.ndarray:
        """The same of these words: three matrices, for the update gate, the reset gate and the candidate."""
        embedded, x, _, bias, *_ = self.weights
        return np.matmul(embedded[words], x.reshape(INPUT, 3, HIDDEN).swapaxes(0, 1)) + bias.reshape(3, 1, HIDDEN)

    def _own(self) -> np.ndarray:
        """What a state adds to the update gate, the reset gate and the candidate: three matrices."""
        return self.weights[2].reshape(HIDDEN, 3, HIDDEN).swapaxes(0, 1)

    def _signed(self) -> np.ndarray:
        """The same with the gates' sign turned, as `step` needs it."""
        own = self._own().copy()
        own[:2] *= -1
        return own

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array with any content, which the next call under this name overwrites: fresh pages cost more than what is done in them."""
        kind, size = self.weights[2].dtype, math.prod(shape)
        if name not in self._spaces or self._spaces[name].size < size or self._spaces[name].dtype != kind:
            self._spaces[name] = np.empty(size, kind)
        return self._spaces[name][:size].reshape(shape)

    def step(self, gates: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, update and reset gates, candidate, and what the state adds to the candidate."""
        return self._step(gates.reshape(len(state), 3, HIDDEN).swapaxes(0, 1), state, self._signed())

    def _step(self, given: np.ndarray, state: np.ndarray, signed: np.ndarray, room: tuple[np.ndarray, ...] = (None, None, None)) -> tuple[np.ndarray, ...]:
        """`step` by what the words add to each gate.

        `signed` are the matrices; `room` is where to write the three gates' parts, the candidate and the new state. Each part lies in one piece.
        """
        own = np.matmul(state, signed, out=room[0])
        both, add = own[:2], own[2]
        both -= given[:2]
        np.exp(both, out=both)
        both += 1
        np.reciprocal(both, out=both)
        update, reset = both
        candidate = np.multiply(reset, add, out=room[1])
        candidate += given[2]
        np.tanh(candidate, out=candidate)
        after = np.subtract(state, candidate, out=room[2])
        after *= update
        after += candidate
        return after, update, reset, candidate, add

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: list[np.ndarray] | None = None):
        """Natural log-probability of each target; with grads, adds the weights' gradients and returns the states', which the next call overwrites.

        Columns are sorted by the targets' classes: a class takes a product, and
        all else is done for all columns at once, those of the rare words, whose
        class is smaller, apart. A state's last value is 1, for the biases.
        """
        *_, classes, class_bias, words, word_bias = self.weights
        kind, n = self.class_of[targets], len(targets)
        order = np.argsort(kind.astype(np.int16), kind="stable")  # so few classes are sorted by counting
        kind, targets = kind[order], targets[order]
        rows = self._space("rows", n, HIDDEN + 1)
        rows[:, :HIDDEN], rows[:, HIDDEN] = states.take(order, axis=0), 1
        all_classes, all_words = np.concatenate([classes, class_bias[None]]), np.concatenate([words, word_bias[None]])
        ends = np.searchsorted(kind, np.arange(len(self.bounds))).tolist()
        bounds = self.bounds.tolist()
        # No width is a power of two, as rows would lie in each other's way in the cache.
        share = np.matmul(all_classes.T, rows.T, out=self._space("share", len(class_bias), n + 16)[:, :n])
        scores, total = _log_share(share, kind)
        place, found, parts = targets - self.bounds[kind], np.empty_like(scores), []
        for first, last, height in ((0, 1, TAIL), (1, len(bounds) - 1, CLASS_WORDS)):
            start, stop = ends[first], ends[last]
            if start == stop:
                continue
            word_share = self._space(f"words {first}", height, stop - start + 16)[:, :stop - start]
            own = [(slice(ends[c], ends[c + 1]), slice(bounds[c], bounds[c + 1]), word_share[:bounds[c + 1] - bounds[c], ends[c] - start:ends[c + 1] - start])
                   for c in range(first, last) if ends[c] < ends[c + 1]]
            for at, part, now in own:
                np.matmul(all_words[:, part].T, rows[at].T, out=now)
                if len(now) < height:
                    word_share[len(now):, at.start - start:at.stop - start] = -1e9
            found[start:stop], word_total = _log_share(word_share, place[start:stop])
            parts.append((start, stop, word_share, word_total, own))
        out = np.empty(n, scores.dtype)
        out[order] = scores + found
        if grads is None:
            return out, None
        columns = np.arange(n)
        share *= np.reciprocal(total)
        share[kind, columns] -= 1
        more = rows.T @ share.T
        grads[4] += more[:HIDDEN]
        grads[5] += more[HIDDEN]
        back = np.matmul(share.T, classes.T, out=self._space("back", n, HIDDEN))
        more, by_words = np.zeros_like(all_words), self._space("by words", n, HIDDEN)
        for start, stop, word_share, word_total, own in parts:
            word_share *= np.reciprocal(word_total)
            word_share[place[start:stop], columns[:stop - start]] -= 1
            for at, part, now in own:
                np.matmul(rows[at].T, now.T, out=more[:, part])
                np.matmul(now.T, words[:, part].T, out=by_words[at])
        back += by_words
        grads[6] += more[:HIDDEN]
        grads[7] += more[HIDDEN]
        unsorted = self._space("unsorted", n, HIDDEN)
        unsorted[order] = back
        return out, unsorted

    def train(self, flat: np.ndarray, starts: np.ndarray) -> None:
        """One pass over whole texts (ids, each with its end) laid in streams; Adam, errors go back `WINDOW` steps.

        Where few streams are left, as in a text much longer than the others,
        windows are summed until a step rests on `STEP` tokens.
        """
        tokens, fresh, places = _streams(flat.astype(np.int32, copy=False), starts, STREAMS, whole=True)
        active = (places >= 0).sum(axis=1)
        if self.moments is None:
            self.moments = [[np.zeros_like(w) for w in self.weights] for _ in range(3)]
        first, second, held = self.moments
        # Blocks that stay in a core's cache while they are worked on.
        blocks = [[a.reshape(-1)[at:at + BLOCK] for a in four] for four in zip(self.weights, held, first, second) for at in range(0, four[0].size, BLOCK)]
        seen, state = 0, np.zeros((tokens.shape[1], HIDDEN), np.float32)
        before = np.full(tokens.shape[1], self.vocabulary.end, np.int32)
        for at in range(0, len(tokens), WINDOW):
            rows, n = slice(at, at + WINDOW), active[at]
            own = int(active[rows].sum())
            state, before = self._window(tokens[rows, :n], fresh[rows, :n], state[:n], before[:n], held, places[rows, :n] >= 0)
            seen += own
            if seen < STEP and at + WINDOW < len(tokens):
                continue
            self.steps += 1
            size = np.sqrt(sum(float(np.vdot(h, h)) for h in held)) / seen
            scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)) / seen)
            rate = RATE * min(1.0, self.steps / WARM) * (1 - 0.9 * at / len(tokens))
            fix_first, fix_second = 1 - 0.9 ** self.steps, 1 - 0.99 ** self.steps
            # The moments are kept as sums, ten and a hundred times the averages, and all constants are put into two.
            by = 0.1 * rate / fix_first
            spread, least = np.float32(0.1 / np.sqrt(fix_second) / by), np.float32(1e-6 / by)
            for w, g, m, v in blocks:
                g *= scale
                m *= np.float32(0.9)
                m += g
                v *= np.float32(0.99)
                np.multiply(g, g, out=g)
                v += g
                np.sqrt(v, out=g)
                g *= spread
                g += least
                np.divide(m, g, out=g)
                w -= g
                g[:] = 0
            seen = 0

    def _window(self, tokens, fresh, state, before, grads, real=None):
        """Add the gradients of the targets, or of those that are `real`: streams may end inside a window."""
        steps, n = tokens.shape
        fed = np.concatenate([before[None], tokens[:-1]])
        fed = np.where(fresh, np.int32(self.vocabulary.end), fed).ravel()
        times = np.bincount(fed, minlength=len(self.class_of))
        words = np.flatnonzero(times)
        gates = self._space("gates", 3, steps, n, HIDDEN)
        np.take(self._by_gate(words), (np.cumsum(times > 0) - 1)[fed], axis=1, out=gates.reshape(3, -1, HIDDEN), mode="clip")
        real_type, first = self.weights[2].dtype, state
        parts = self._space("parts", 3, steps, n, HIDDEN)
        candidates, states = self._space("candidates", steps, n, HIDDEN), self._space("states", steps, n, HIDDEN)
        anew, signed = fresh.any(axis=1).tolist(), self._signed()
        for t in range(steps):
            if anew[t]:
                state = np.where(fresh[t][:, None], real_type.type(0), state)
            state = self._step(gates[:, t], state, signed, (parts[:, t], candidates[t], states[t]))[0]
        flat, targets = states.reshape(-1, HIDDEN), tokens.ravel()
        if real is None or real.all():
            _, back = self.outputs(flat, targets, grads)
        else:
            back, real = np.zeros_like(flat), real.ravel()
            back[real] = self.outputs(flat[real], targets[real], grads)[1]
        back = back.reshape(steps, n, HIDDEN)
        olds = self._space("olds", steps, n, HIDDEN)
        olds[0], olds[1:] = first, states[:-1]
        olds[fresh] = 0
        # What an error is multiplied by does not depend on later errors: it is made for all steps at once, where its parts were.
        update, reset, add = parts
        rest, to_update = np.subtract(1, update, out=self._space("rest", steps, n, HIDDEN)), self._space("to_update", steps, n, HIDDEN)
        np.subtract(olds, candidates, out=to_update)
        to_update *= update
        to_update *= rest
        to_candidate = np.multiply(candidates, candidates, out=candidates)
        np.subtract(1, to_candidate, out=to_candidate)
        to_candidate *= rest
        to_reset = np.multiply(add, reset, out=add)
        to_reset *= np.subtract(1, reset, out=rest)
        # Errors lie side by side: of the candidate's share of the state, the update gate, the reset gate and the candidate.
        own = np.ascontiguousarray(self._own()[[2, 0, 1]].swapaxes(1, 2)).reshape(3 * HIDDEN, HIDDEN)
        errors, later = self._space("errors", steps, n, 4 * HIDDEN), np.zeros((n, HIDDEN), real_type)
        inner, room = np.empty((n, HIDDEN), real_type), np.empty((n, HIDDEN), real_type)
        by_part = errors.reshape(steps, n, 4, HIDDEN)
        for t in range(steps - 1, -1, -1):
            d, (of_share, of_update, of_reset, of_candidate) = back[t], by_part[t].swapaxes(0, 1)
            d += later
            np.multiply(d, to_candidate[t], out=inner)
            np.multiply(d, to_update[t], out=of_update)
            np.multiply(inner, to_reset[t], out=of_reset)
            np.multiply(inner, reset[t], out=of_share)
            of_candidate[:] = inner
            np.multiply(d, update[t], out=later)
            later += np.matmul(errors[t, :, :3 * HIDDEN], own, out=room)
            if anew[t]:
                later[fresh[t]] = 0
        errors = errors.reshape(-1, 4 * HIDDEN)
        of_own = olds.reshape(-1, HIDDEN).T @ errors[:, :3 * HIDDEN]
        grads[2][:, :2 * HIDDEN] += of_own[:, HIDDEN:]
        grads[2][:, 2 * HIDDEN:] += of_own[:, :HIDDEN]
        # A word adds the same to the gates in all its places, so that its errors are summed first.
        order = np.argsort(fed.astype(np.min_scalar_type(len(self.class_of))), kind="stable")  # few words are sorted by counting
        by_often, of_words = _sums_of_runs(errors[:, HIDDEN:][order], times[words])
        words = words[by_often]
        grads[1] += self.weights[0][words].T @ of_words
        grads[3] += of_words.sum(axis=0)
        grads[0][words] += of_words @ self.weights[1].T
        return state.copy(), tokens[-1]

    def score(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log-probability of every id, the state carried through each whole text."""
        flat = flat.astype(np.int32, copy=False)
        tokens, fresh, places = _streams(flat, starts, SCORED, whole=True)
        out = np.zeros(len(flat), np.float64)
        gates, signed = self._by_gate(np.arange(len(self.class_of))), self._signed()
        active, anew = (places >= 0).sum(axis=1).tolist(), fresh.any(axis=1).tolist()
        streams = tokens.shape[1]
        state, before = np.zeros((streams, HIDDEN), np.float32), np.full(streams, self.vocabulary.end)
        states = np.empty((OUTPUTS + streams, HIDDEN), np.float32)
        first, size = 0, 0
        for t, n in enumerate(active):
            state, before = state[:n], before[:n]
            if anew[t]:
                new = fresh[t, :n]
                state = np.where(new[:, None], np.float32(0), state)
                before = np.where(new, self.vocabulary.end, before)
            given = np.take(gates, before, axis=1, out=self._space("given", 3, n, HIDDEN), mode="clip")
            state = self._step(given, state, signed, (self._space("parts", 3, n, HIDDEN), self._space("candidates", n, HIDDEN), states[size:size + n]))[0]
            before = tokens[t, :n]
            size += n
            if size >= OUTPUTS or t == len(active) - 1:
                at = places[first:t + 1]
                at = at[at >= 0]
                out[at] = self.outputs(states[:size], flat[at])[0]
                first, size = t + 1, 0
        return out


def _sums_of_runs(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs by falling length, and the sums of their rows; each run has a row at least."""
    runs = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[runs], (np.cumsum(lengths) - lengths)[runs]
    often = int(np.searchsorted(-lengths, -OFTEN, "right"))
    out = np.empty((len(runs), values.shape[1]), values.dtype)
    ones = np.ones(int(lengths.max(initial=0)), values.dtype)
    for i, (at, n) in enumerate(zip(starts[:often].tolist(), lengths[:often].tolist())):
        np.matmul(ones[:n], values[at:at + n], out=out[i])
    starts, out_few = starts[often:], out[often:]
    np.take(values, starts, axis=0, out=out_few, mode="clip")
    longer = np.searchsorted(-lengths[often:], -np.arange(OFTEN), "left").tolist()  # how many runs have more than so many rows
    for k in range(1, OFTEN - 1):
        if not longer[k]:
            break
        out_few[:longer[k]] += values.take(starts[:longer[k]] + k, axis=0)
    return runs, out


def _log_share(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of each column's softmax at its target, and each column's sum; the logits become what the softmax divides by it."""
    logits -= logits.max(axis=0)
    scores = logits[targets, np.arange(len(targets))]
    total = np.exp(logits, out=logits).sum(axis=0)
    return scores - np.log(total), total


def _streams(flat: np.ndarray, starts: np.ndarray, streams: int, whole: bool = False):
    """Texts behind each other in so many columns of similar length, and where a text begins.

    Nothing is left out: columns are sorted by length. With `whole`, places in
    `flat` are returned as well, -1 behind a column's end.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    streams = max(1, min(streams, len(order)))
    column, fill, shortest = np.zeros(len(order), np.int64), np.zeros(streams, np.int64), [(0, c) for c in range(streams)]
    for i, n in enumerate(lengths[order].tolist()):  # longest texts first, each to the column that is shortest so far
        size, column[i] = shortest[0]
        fill[column[i]] = size + n
        heapq.heapreplace(shortest, (size + n, int(column[i])))
    # Within a column in any order, so that training does not end with the shortest texts of all.
    mixed = np.lexsort((np.random.default_rng(11).permutation(len(order)), column))
    order, column = order[mixed], column[mixed]
    offset = np.cumsum(lengths[order]) - lengths[order]
    offset -= np.concatenate([[0], np.cumsum(fill)])[column]
    rank = np.empty(streams, np.int64)
    rank[np.argsort(-fill, kind="stable")] = np.arange(streams)
    places = np.full((int(fill.max()) if len(order) else 0, streams), -1, np.int32)
    for some in np.array_split(np.arange(len(order)), -(-len(flat) // PLACED) or 1):  # a part of the texts at a time
        n = lengths[order[some]]
        own = np.repeat(some, n)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        places[offset[own] + inside, rank[column[own]]] = starts[order[own]] + inside
    fresh = np.zeros(places.shape, bool)
    fresh[offset, rank[column]] = True
    tokens = flat[places] if len(places) else np.zeros((0, streams), np.int64)  # any token stands behind an end
    return (tokens, fresh, places) if whole else (tokens, fresh)


def _encoded(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ends, and their starts; a piece of the texts at a time, as words take more room than ids."""
    parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at, stop in by_bytes(texts, PIECE_BYTES):
        words, starts = split_words(texts.slice(at, stop - at), lower=True)
        ids, starts = _with_ends(vocabulary, vocabulary.ids(words), starts)
        parts.append(ids)
        ends.append(ends[-1][-1] + starts[1:])
    return np.concatenate(parts), np.concatenate(ends)


def _with_ends(vocabulary: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with each text's end behind it, and their starts."""
    ends = starts + np.arange(len(starts))
    out = np.full(len(ids) + len(starts) - 1, vocabulary.end, np.int32)
    real = np.ones(len(out), bool)
    real[ends[1:] - 1] = False
    out[real] = ids
    return out, ends


def _dealt(words: pa.Array, buckets: int) -> np.ndarray:
    """Which bucket each word, of a byte at least, belongs to: a hash of its bytes and their places."""
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    raw, lengths, out = np.frombuffer(words.buffers()[2], np.uint8), np.diff(places), np.empty(len(words), np.int64)
    of_byte, of_place = mix(np.arange(256), 1), mix(np.arange(64), 2) | np.uint64(1)
    for at, stop in stretches(lengths, 1 << 19):  # each byte takes many times its room
        starts = places[at:stop] - places[at]
        part = raw[places[at]:places[stop]]
        inside = np.arange(len(part)) - np.repeat(starts, lengths[at:stop])
        out[at:stop] = mix(np.add.reduceat(of_byte[part] * of_place[inside % 64], starts), 3) % np.uint64(buckets)
    return out


def _packed(words: pa.Array, counts: np.ndarray) -> bytes:
    """Words and their counts as one value, so that they are moved as a piece."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([words.cast(pa.large_string()), pa.array(counts, pa.int64())], names=["word", "c"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(values: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words and counts of all values behind each other, and how many are each value's."""
    kind = pa.schema([("word", pa.large_string()), ("c", pa.int64())])
    tables = [pa.ipc.open_stream(value).read_all() for value in values.to_pylist()]
    whole = pa.concat_tables([kind.empty_table(), *tables]).combine_chunks()
    return strings(whole["word"]), np.concatenate([np.zeros(0, np.int64), *map(np.asarray, whole["c"].chunks)]), np.array([t.num_rows for t in tables], np.int64)


def counted(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """`_chunk`, `packed`: the different words of each chunk of texts with how often all training texts have them, in several
    rows; and `word`, `c`: all words with these counts.

    Words are dealt to buckets by a hash. A chunk sends a bucket its words in
    one row, and the bucket counts them and sends a row back to each chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch.column(0))
            chunks, learn = np.asarray(batch.column(0).take(order)), np.asarray(batch.column(1).take(order))
            texts = strings(batch.column(2).take(order))
            for at, stop in by_bytes(texts, CHUNK_BYTES):
                codes, starts, words = word_codes(texts.slice(at, stop - at), lower=True)
                words = pa.concat_arrays([words, pa.array([END], words.type)])
                dealt = _dealt(words, buckets)
                slot, part = np.unique(chunks[at:stop], return_inverse=True)
                # Every text has an end; it is the last word of the list.
                for k in range(len(slot)):
                    own = part == k
                    inside = np.repeat(own, np.diff(starts))
                    learnt = inside & np.repeat(learn[at:stop], np.diff(starts))
                    there = np.bincount(codes[inside], minlength=len(words))
                    times = np.bincount(codes[learnt], minlength=len(words))
                    there[-1], times[-1] = 1, (own & learn[at:stop]).sum()
                    found = np.flatnonzero(there)
                    found = found[np.argsort(dealt[found], kind="stable")]
                    to, first = np.unique(dealt[found], return_index=True)
                    rows = [_packed(words.take(pa.array(now)), times[now]) for now in np.split(found, first[1:])]
                    yield pa.record_batch([pa.array(to), pa.array(np.full(len(to), slot[k])), pa.array(rows, pa.binary())],
                                          names=["_bucket", "_chunk", "packed"])

    def count(rows: pa.Table) -> pa.Table:
        words, n, sizes = _unpacked(rows["packed"])
        coded = words.dictionary_encode()
        codes, totals = np.asarray(coded.indices), np.zeros(len(coded.dictionary), np.int64)
        np.add.at(totals, codes, n)
        back, ends = totals[codes], np.cumsum(sizes)
        out = [_packed(words.slice(e - m, m), back[e - m:e]) for e, m in zip(ends, sizes)]
        # The row without a chunk has the bucket's words once each.
        whole = pa.table({"_chunk": pa.concat_arrays([rows["_chunk"].combine_chunks(), pa.array([None], pa.int64())]),
                          "packed": pa.array([*out, _packed(coded.dictionary, totals)], pa.binary())})
        give_back()
        return whole

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, c, _ = _unpacked(batch.column(0).slice(i, 1))
                for at in range(0, len(words), 100_000):
                    yield pa.record_batch([words.slice(at, 100_000).cast(pa.string()), pa.array(c[at:at + 100_000])], names=["word", "c"])

    rows = docs.select("_chunk", "_learn", "_text").mapInArrow(thrifty(run), "_bucket long, _chunk long, packed binary")
    both = tabled(rows.groupBy("_bucket").applyInArrow(count, "_chunk long, packed binary"), "chunk-words", few=False)
    totals = tabled(both.filter("_chunk is null").select("packed").mapInArrow(thrifty(unpack), "word string, c long"), "words", few=False)
    return both.filter("_chunk is not null"), totals


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, c): totals, the `WORDS` most frequent, and the weight of the others by kind; that much reaches the driver."""
    known = counts.filter("c > 0")
    top = known.orderBy(F.desc("c"), "word").limit(WORDS).collect()
    words, least = [r.word for r in top], [r.c for r in top]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = kinds(strings(batch.column(0)))
            c = np.asarray(batch.column(1))
            yield pa.record_batch([pa.array(np.arange(TAIL)), pa.array(np.bincount(kind, weights=c, minlength=TAIL)),
                                   pa.array(np.bincount(kind, minlength=TAIL).astype(np.float64))], names=["k", "c", "d"])

    tail = known.select("word", "c").mapInArrow(thrifty(weigh), "k long, c double, d double").groupBy("k").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    of_kind = np.zeros((2, TAIL))
    for row in tail.collect():
        of_kind[:, row.k] = row.c, row.d
    tokens, distinct = int(of_kind[0].sum()), int(of_kind[1].sum())
    if words:
        own = kinds(pa.array(words, pa.large_string()))
        of_kind[0] -= np.bincount(own, weights=least, minlength=TAIL)
        of_kind[1] -= np.bincount(own, minlength=TAIL)
    return Vocabulary(words, np.array(least, np.float64), of_kind[0], of_kind.sum(axis=0), tokens, distinct)


def fit(docs: DataFrame, found: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of training in all tasks at once, from common weights, which are then averaged by tokens trained on.

    Round i takes the training texts whose row hash is i modulo `rounds`, so
    that each training text is learnt from once. Averages are taken in levels
    of `FAN_IN` sets of weights, until the driver gets that many at most.
    """
    model, trained = Model(found), 0
    context = docs.sparkSession.sparkContext
    for i in range(rounds):
        shared = context.broadcast((found.plain(), model.weights))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Model(Vocabulary(*shared.value[0]), [w.copy() for w in shared.value[1]]), 0
            for batch in batches:
                texts = strings(batch.column(0))
                for at, stop in by_bytes(texts, SLICE_BYTES):
                    ids, starts = _encoded(own.vocabulary, texts.slice(at, stop - at))
                    give_back()  # the words are larger than all that training needs
                    own.train(ids, starts)
                    seen += len(ids)
            if seen:
                weights = np.concatenate([w.ravel() for w in own.weights]).astype(np.float32)
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([float(seen)]),
                                       pa.array([weights.tobytes()], pa.binary())], names=["node", "seen", "weights"])

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(s * np.frombuffer(w, np.float32).astype(np.float64) for s, w in zip(rows["seen"], rows["weights"]))
            return pd.DataFrame({"node": [rows["node"].iloc[0] // FAN_IN], "seen": [rows["seen"].sum()],
                                 "weights": [(total / rows["seen"].sum()).astype(np.float32).tobytes()]})

        kind = "node long, seen double, weights binary"
        rows = docs.filter(F.col("_learn") & (F.pmod(F.xxhash64("_r1", F.lit(7)), F.lit(rounds)) == i)).select("_text")
        learnt = held(rows.mapInArrow(thrifty(learn), kind))
        while learnt.count() > FAN_IN:
            learnt = held(learnt.groupBy(F.floor(F.col("node") / FAN_IN)).applyInPandas(average, kind))
        got = learnt.toPandas()
        if len(got):
            whole = average(got).iloc[0]
            flat, trained = np.frombuffer(whole["weights"], np.float32), trained + int(whole["seen"])
            ends = np.cumsum([w.size for w in model.weights])
            model = Model(found, [flat[e - w.size:e].reshape(w.shape).copy() for w, e in zip(model.weights, ends)])
    model.trained = trained
    return model


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, `learn`, tokens, known tokens and two log10 probabilities of the whole text.

    Words are what lies between white space (20, 09 to 0D), A to Z lowered;
    every text, empty and null ones too, ends in a token of its own. All counts
    and the model come from rows where `learn` is true (null: false).
    `base_score` takes words as independent with add-one counts. `score` is the
    recurrent model's: the class and the word given all before, and for a rare
    word its kind and its share, add-one, of that kind, so that every text has
    a probability. Rows are told apart by id and text; repeats get each their row.

    A chunk is what one split of a file holds, cut by a hash to about
    `CHUNK_BYTES` (tables that are not read from files are only cut). Its
    different words go to the count of all chunks and come back with it, so the
    whole vocabulary is never in one place.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"),
                                     F.coalesce(learn, F.lit(False)).alias("_learn"),
                                     F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("_split")), "_id", "_text")
    largest, size = keyed.groupBy("_split").agg(F.sum(F.octet_length("_text")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    part = F.pmod(F.xxhash64("_r1", F.lit(99)), F.lit(max(1, -(-(largest or 0) // CHUNK_BYTES))))
    keyed = keyed.withColumn("_chunk", F.xxhash64("_split", part))
    told, totals = counted(keyed, max(1, -(-(size or 0) // BUCKET_BYTES)))
    found = vocabulary(totals)
    model = fit(keyed, found)
    shared = docs.sparkSession.sparkContext.broadcast((found.plain(), model.weights))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        plain, weights = shared.value
        found = Vocabulary(*plain)
        own = Model(found, weights)
        rows = strings(texts["_text"])
        learnt, c, _ = _unpacked(known["packed"])
        end = c[pc.index(learnt, pa.scalar(END, learnt.type)).as_py()] if len(c) else 0
        base = np.log10((c + 1) / (found.tokens + found.distinct + 1))
        base_end = np.log10((end + 1) / (found.tokens + found.distinct + 1))
        output = found.ids(learnt)
        rare = np.where(output < TAIL, np.log10((c + 1) / (found.tail_weight[np.minimum(output, TAIL - 1)] + 1)), 0)
        out = []
        for at, stop in by_bytes(rows, SLICE_BYTES):
            words, word_starts = split_words(rows.slice(at, stop - at), lower=True)
            codes = np.asarray(pc.index_in(words, learnt))  # fails if a word is not there: the chunk's list has them all
            del words
            give_back()  # the texts' words are as large as all that scoring needs
            ids, starts = _with_ends(found, output[codes], word_starts)
            n_known, by_words, by_rare = (sums(of[codes], word_starts) for of in (c > 0, base, rare))
            del codes
            total = sums(own.score(ids, starts), starts) / np.log(10)
            if END not in found.words:
                total += np.log10(1 / (found.tail_weight[0] + 1))
            out.append(pa.table({"_id": texts["_id"].slice(at, stop - at), "_learn": texts["_learn"].slice(at, stop - at),
                                 "n_tokens": np.diff(starts), "n_known": n_known.astype(np.int64) + int(end > 0),
                                 "base_score": by_words + base_end, "score": total + by_rare}))
        give_back()
        return pa.concat_tables(out) if out else pa.table({"_id": texts["_id"], "_learn": texts["_learn"], "n_tokens": pa.array([], pa.int64()),
                                                           "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()),
                                                           "score": pa.array([], pa.float64())})

    scored = keyed.select("_chunk", "_id", "_learn", "_text").groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(
        run, f"_id {kind}, _learn boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), F.col("_learn").alias("learnt"), "n_tokens", "n_known",
                         F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op8_gru_lm")
def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
