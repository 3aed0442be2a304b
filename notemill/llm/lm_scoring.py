"""Log-probabilities of whole texts by a small causal self-attention model over subword ids.

A text is its words, A-Z lower-cased, and one end. Each word, with a space in front, becomes the ids of a public byte-level
vocabulary; nothing joins across words, so the different words of a batch are encoded as one text. An id's probability is
that of its class, given the ids before, times its share of the class. Classes are the most frequent ids, one each, and bins of
about equal mass for the others; shares and classes come from the counts of all training words (`word_counts`, `id_counts`).
All ids together have probability one at every place.

The class is predicted by one block of causal self-attention with a feed-forward layer (`Model`), written in numpy. Windows
of WINDOW inputs overlap by half: each scores its later half once, with half to all of a window as its context; a text
starts after a window of begin marks. Batches of windows are scored by batched masked products (`Model.forward`), whose arrays are
kept and written over (`Kept`).

Texts are turned into classes once (`encoded`), and training and scoring read these. Training (`train`) is parallel and takes every position of
every training text as a target once: the windows are those that score a text, each round takes those of one remainder, every partition goes over
its own with Adam steps from the shared weights, and the mean of all partitions' weights, by windows, starts the next round. Sums of weights are added up in
tasks; the driver holds one set at a time.

The base score is that of single words with one added to each count. Words with over 1/HOT_WORDS of all occurrences, at
most HOT_WORDS of them, are sent to the tasks with their counts and ids; all others meet their counts by a join on the word, where none of them
is frequent. Memory of a task: those words, one batch of texts, one set of work arrays.

Defined cases: null and empty texts are the end alone; a null id counts as a training document; repeated rows
are documents of their own; very long texts and words are scored whole, window by window; clashing columns are not read; without
training documents the model is its starting point and every count 0; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import ctypes
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

HOT_WORDS = 500_000
WINDOW, STRIDE = 48, 32
CONTEXT = WINDOW - STRIDE
WIDTH, HIDDEN = 32, 32
GROUPS, SIZE = 16, 32
BINS = 64
SINGLE = GROUPS * SIZE - BINS
BEGIN = GROUPS * SIZE  # an input class besides those that are predicted
END_ID = 50256
RARE = 0.1  # added to the count of every id
#: Windows per step, least steps of a partition in a round, most steps over windows that are held at once, rounds.
STEP_WINDOWS, MIN_STEPS, STEPS, ROUNDS = 128, 48, 256, 4
RATE = 0.015
BATCH_BYTES, WORDS_BYTES, COUNT_BYTES = 2 << 20, 4 << 20, 8 << 20
CHUNK = 128  # windows that are worked on at once: their arrays stay near the core
DIGITS = 4  # of a score; further ones differ with the batch a text is scored in, as single precision does

SPACES = bytes([32, *range(9, 14)])
#: All else that Unicode or Python counts as white space.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library(path: str):
    """The vocabulary; strings of special tokens in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def one_thread() -> None:
    """A task works in one thread: more would wait on each other beside the executor's other tasks."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        limit = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if limit:
            limit(1)


def flat_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words with a space in front, one word after the other, and how many each has.

    They are encoded as one text: no piece reaches over a single space. Words with white space of other kinds inside, which
    joins with what stands beside it, are encoded alone.
    """
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    encode = library(path).encode_ordinary
    text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", pa.large_binary()))[0].as_py().decode()
    if not OTHER_SPACE.search(text):
        flat = np.array(encode(text), np.int64)
        first = np.flatnonzero(word_starts(path)[flat])
        return flat, np.diff(first, append=len(flat))
    odd = pc.match_substring_regex(words.cast(pa.large_string()), OTHER_SPACE.pattern).to_numpy(zero_copy_only=False)
    alone = [encode(" " + w.decode()) for w in words.filter(pa.array(odd)).to_pylist()]
    plain, plain_length = flat_ids(words.filter(pa.array(~odd)), path)
    length = np.empty(len(words), np.int64)
    length[odd], length[~odd] = [len(i) for i in alone], plain_length
    flat, of_odd = np.empty(length.sum(), np.int64), np.repeat(odd, length)
    flat[of_odd], flat[~of_odd] = np.concatenate(alone), plain
    return flat, length


def word_ids(words: list[bytes], path: str) -> list[list[int]]:
    """Ids of each word with a space in front."""
    flat, length = flat_ids(pa.array(words, pa.large_binary()), path)
    return [i.tolist() for i in np.split(flat, np.cumsum(length)[:-1])] if words else []


@lru_cache(maxsize=2)
def word_starts(path: str) -> np.ndarray:
    """Whether each id, the end included, begins with the space before a word."""
    return np.array([library(path).decode_single_token_bytes(i)[:1] == b" " for i in range(END_ID)] + [False])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, A-Z lower-cased, one text after the other, and how many each text has."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data else b""
    low = np.frombuffer(data.translate(LOWER), np.uint8)
    bounds = bounds - bounds[0]
    inside = low != 32
    cuts = np.zeros(len(low) + 1, bool)
    cuts[bounds] = True  # a word ends with its text
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cuts[1:-1]
    end[:-1] &= ~inside[1:] | cuts[1:-1]
    first = np.flatnonzero(start)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - first)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(LOWER, SPACES))])
    return words, np.diff(np.searchsorted(first, bounds))


def in_training(held_out: Column) -> Column:
    return ~F.coalesce(held_out, F.lit(False))


# -- counts of the corpus


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """word, n in training texts, n_all in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, COUNT_BYTES):
            words, per_text = split_words(batch.column(0))
            coded = words.dictionary_encode()
            code, listed = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string()).cast(pa.string())
            own = code[np.repeat(batch.column(1).to_numpy(zero_copy_only=False), per_text)]
            n, n_all = (pa.array(np.bincount(c, minlength=len(listed))) for c in (own, code))
            yield pa.record_batch([listed, n, n_all], ["word", "n", "n_all"])

    rows = docs.select("text", training.alias("training")).mapInArrow(run, "word string, n bigint, n_all bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def id_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """Occurrences of every id in the training words; at most one entry per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END_ID + 1, np.int64)
        for batch in small_batches(batches, 0, BATCH_BYTES):
            flat, length = flat_ids(batch.column(0).cast(pa.large_binary()), path)
            np.add.at(total, flat, np.repeat(batch.column(1).to_numpy(), length))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = counts.where("n > 0").select("word", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


class Classes:
    """Class of every id and the logarithm of its share in the class.

    Word starts and the ids inside words are numbered apart, each from the most frequent on: ids that
    stand in like places share groups of SIZE classes.
    """

    def __init__(self, counts: dict[int, int], starts: np.ndarray):
        n = np.full(len(starts), RARE)
        n[list(counts)] += list(counts.values())
        order = np.argsort(-n, kind="stable")
        single, rest = order[:SINGLE], order[SINGLE:]
        single = single[np.argsort(~starts[single], kind="stable")]
        before = np.cumsum(n[rest]) - n[rest]
        self.of = np.empty(len(n), np.int16)
        self.of[single] = np.arange(SINGLE)
        self.of[rest] = SINGLE + np.minimum((BINS * before / n[rest].sum()).astype(np.int64), BINS - 1)
        self.mass = np.maximum(np.bincount(self.of, weights=n, minlength=BEGIN), 1e-9)
        self.share = np.log(n / self.mass[self.of])


# -- the model


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials, in place, of scores or logits within LIMIT."""
    if x.size and (x.max() > LIMIT or x.min() < -LIMIT):
        np.clip(x, -LIMIT, LIMIT, out=x)
    return np.exp(x, out=x)


def _added(a: np.ndarray) -> np.ndarray:
    """Sum over the first axis, as a product with ones."""
    return (np.ones(len(a), a.dtype) @ a.reshape(len(a), math.prod(a.shape[1:]))).reshape(a.shape[1:])


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


#: Place i of the later half sees the inputs up to its own.
MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(STRIDE)[:, None] + CONTEXT, 1, 0).astype(np.float32)
#: Bound of scores and logits, whose exponentials and their sums then have no overflow; far above what training reaches.
LIMIT = 60
#: Of logits: those of groups, and those of members.
HALVES = np.repeat(np.eye(2), [GROUPS, SIZE], axis=0)
TINY = 1e-30
#: Places of a class's row among pairs of numbers.
CELLS = np.arange((BEGIN + 1) * WIDTH // 2).reshape(BEGIN + 1, WIDTH // 2)
SHAPES = {
    "tokens": (BEGIN + 1, WIDTH), "places": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
    "inner": (WIDTH, HIDDEN), "outer": (HIDDEN, WIDTH), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,),
    "member": (GROUPS, WIDTH, SIZE), "member_bias": (GROUPS, SIZE),
}


class Kept:
    """Arrays by name that are written again: over new ones each time a step takes twice as long."""

    def __init__(self, kind: np.dtype):
        self.kind, self.arrays = kind, {}

    def __call__(self, name: str, *shape: int, kind: np.dtype | None = None) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.arrays or len(self.arrays[name]) < size:
            self.arrays[name] = np.empty(size, kind or self.kind)
        return self.arrays[name][:size].reshape(shape)


class Model:
    """Weights and their gradients; inputs are classes, (windows, WINDOW), targets those of the later half.

    A class is predicted as its group and, by the group's own weights, as the member of it. What a layer makes of an input is the
    sum of its class's and its place's part, and these stand in tables: gradients are added up by class and by place first and
    multiplied by the weights then. Results of the inner steps stay until the next windows.
    """

    def __init__(self, weights: dict[str, np.ndarray], kept: Kept | None = None):
        self.w = w = weights
        self.kept = kept or Kept(w["key"].dtype)
        self.query = w["query"] / math.sqrt(WIDTH)
        tokens, places = w["tokens"], w["places"]
        #: Parts of classes and places in keys, values and queries.
        self.parts = {"key": (tokens @ w["key"], places @ w["key"]), "value": (tokens @ w["value"], places @ w["value"])}
        self.parts |= {"query": (tokens @ self.query, places[CONTEXT:] @ self.query), "late": (tokens, places[CONTEXT:])}
        #: Of each group: weights of the logits of all groups, then of its members; the same, transposed; biases.
        self.joint = np.concatenate([np.broadcast_to(w["group"], (GROUPS, WIDTH, GROUPS)), w["member"]], 2)
        self.turned = np.ascontiguousarray(self.joint.transpose(0, 2, 1))
        self.bias = np.concatenate([np.broadcast_to(w["group_bias"], (GROUPS, GROUPS)), w["member_bias"]], 1)

    @staticmethod
    def start(mass: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 1 / math.sqrt(WIDTH), s).astype(np.float32) for k, s in SHAPES.items()}
        for k, scale in {"places": 0.3, "outer": 0.3, "group": 0.1, "member": 0.1}.items():
            w[k] *= np.float32(scale)
        by_group = mass.reshape(GROUPS, SIZE)
        w["group_bias"] = np.log(by_group.sum(1) / mass.sum()).astype(np.float32)
        w["member_bias"] = np.log(by_group / by_group.sum(1, keepdims=True)).astype(np.float32)
        return Model(w)

    def _product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b, out=self.kept(name, *a.shape[:-1], b.shape[-1]))

    def _rows(self, name: str, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(a, at, axis=0, out=self.kept(name, *at.shape, a.shape[1]), mode="clip")

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Last layer of the later half, (places, WIDTH), and what the gradients need."""
        w, late = self.w, np.ascontiguousarray(x[:, CONTEXT:])
        k, v, q, mid = (self._rows(p, self.parts[p][0], i) for p, i in (("key", x), ("value", x), ("query", late), ("late", late)))
        for rows, p in (k, "key"), (v, "value"), (q, "query"), (mid, "late"):
            rows += self.parts[p][1]
        seen = _exp(self._product("seen", q, k.transpose(0, 2, 1)))
        seen *= MASK
        total = (_flat(seen) @ np.ones(WINDOW, seen.dtype)).reshape(*late.shape, 1)
        from_seen = self._product("from_seen", seen, v)
        from_seen /= total
        mid += from_seen
        mid = _flat(mid)
        inner = self._product("inner", mid, w["inner"])
        np.maximum(inner, 0, out=inner)
        top = self._product("top", inner, w["outer"])
        top += mid
        return top, (late, q, k, v, seen, total, from_seen, mid, inner)

    def _logits(self, top: np.ndarray, y: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
        """Exponentials of the logits and their sums for the targets y, which are in ascending order and stand at the places
        `order`; the rows they come from, where each target's row, group and member are among them, and each group's blocks.

        Places are dealt to blocks of STRIDE, each of one group; what a block has left over is some place again, and not read.
        """
        n = np.diff(np.searchsorted(y, np.arange(0, BEGIN + 1, SIZE)))
        blocks = -(-n // STRIDE)
        group = np.repeat(np.arange(GROUPS), n)
        at = np.arange(len(y)) + ((np.cumsum(blocks) - blocks) * STRIDE - (np.cumsum(n) - n))[group]
        of_block = np.repeat(np.arange(GROUPS), blocks)
        places = np.zeros(len(of_block) * STRIDE, np.int64)
        places[at] = order
        own = self._rows("own", top, places).reshape(-1, STRIDE, WIDTH)
        joint = self._rows("joint", self.joint.reshape(GROUPS, -1), of_block).reshape(-1, WIDTH, GROUPS + SIZE)
        z = self._product("logits", own, joint)
        z += self.bias[of_block, None]
        z = _flat(_exp(z))
        start = at * z.shape[1]
        start += group
        cells = np.stack([start, start + (GROUPS + y - group * (SIZE + 1))])
        return z, z @ HALVES.astype(z.dtype), own, at, cells, of_block

    def log_probabilities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(class) of targets y, (windows, STRIDE)."""
        order = np.argsort(y.ravel().astype(np.int16), kind="stable")
        z, sums, _, at, cells, _ = self._logits(self.forward(x)[0], y.ravel()[order], order)
        log = np.log(z.ravel()[cells] + TINY)
        out = np.empty(y.shape, self.bias.dtype)
        out.ravel()[order] = log[0] + log[1] - np.log(sums).sum(1)[at]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the targets (those below zero are none) and its gradients."""
        w = self.w
        g = {k: np.zeros_like(v) for k, v in w.items()}
        #: Gradients of the parts of classes and of places.
        sums = {p: [np.zeros_like(t) for t in tables] for p, tables in self.parts.items()}
        n = max(np.count_nonzero(y >= 0), 1)
        loss = sum(self._add_gradients(x[a : a + CHUNK], y[a : a + CHUNK], n, g, sums) for a in range(0, len(x), CHUNK))
        for part, weights in ("key", w["key"]), ("value", w["value"]), ("query", self.query):
            scale = 1 / math.sqrt(WIDTH) if part == "query" else 1
            of_classes, of_places = sums[part]
            first = WINDOW - len(of_places)
            g["tokens"] += of_classes @ weights.T
            g["places"][first:] += of_places @ weights.T
            g[part] += (w["tokens"].T @ of_classes + w["places"][first:].T @ of_places) * scale
        g["tokens"] += sums["late"][0]
        g["places"][CONTEXT:] += sums["late"][1]
        return loss / n, g

    def _add_gradients(self, x: np.ndarray, y: np.ndarray, n: int, g: dict[str, np.ndarray], sums: dict[str, list[np.ndarray]]) -> float:
        """Adds a few windows' share of n targets, returns their loss."""
        w, kept = self.w, self.kept
        top, (late, q, k, v, seen, total, from_seen, mid, inner) = self.forward(x)
        order = np.argsort(y.ravel().astype(np.int16), kind="stable")
        order = order[np.count_nonzero(y < 0) :]
        z, z_sums, own, at, cells, of_block = self._logits(top, y.ravel()[order], order)
        z *= self._product("scale", 1 / (n * z_sums), HALVES.T.astype(z.dtype))
        p = z.ravel()[cells]
        left_over = np.ones(len(z), bool)
        left_over[at] = False
        z[left_over] = 0
        z.ravel()[cells] = p - 1 / n
        z = z.reshape(*own.shape[:2], GROUPS + SIZE)
        part, bias = self._product("part", own.transpose(0, 2, 1), z), np.matmul(np.ones((1, STRIDE), z.dtype), z)
        ends = np.searchsorted(of_block, np.arange(GROUPS + 1)).tolist()
        for m, (a, b) in enumerate(zip(ends, ends[1:])):
            for names, sums_of in (("group", "member"), _added(part[a:b])), (("group_bias", "member_bias"), _added(bias[a:b])[0]):
                g[names[0]] += sums_of[..., :GROUPS]
                g[names[1]][m] += sums_of[..., GROUPS:]
        back = np.full(len(top), len(z) * STRIDE)
        back[order] = at
        d_own = kept("d_own", len(z) * STRIDE + 1, WIDTH)
        d_own[-1] = 0  # of places that are no targets
        joint = self._rows("joint", self.turned.reshape(GROUPS, -1), of_block).reshape(-1, GROUPS + SIZE, WIDTH)
        np.matmul(z, joint, out=d_own[:-1].reshape(own.shape))
        d = self._rows("d", d_own, back)
        blocks = from_seen.shape
        g["outer"] += _added(self._product("products", inner.reshape(blocks).transpose(0, 2, 1), d.reshape(blocks)))
        d_in = self._product("d_in", d, w["outer"].T)
        d_in *= inner > 0
        g["inner"] += _added(self._product("products", mid.reshape(blocks).transpose(0, 2, 1), d_in.reshape(blocks)))
        d += self._product("d_mid", d_in, w["inner"].T)
        d = d.reshape(blocks)
        d_sum = np.divide(d, total, out=kept("d_sum", *blocks))
        d_v = self._product("d_v", seen.transpose(0, 2, 1), d_sum)
        d_s = self._product("d_s", d_sum, v.transpose(0, 2, 1))
        d_s -= np.vecdot(d_sum, from_seen)[..., None]
        d_s *= seen
        d_q, d_k = self._product("d_q", d_s, k), self._product("d_k", d_s.transpose(0, 2, 1), q)
        for i, parts in (x, {"key": d_k, "value": d_v}), (late, {"query": d_q, "late": d}):
            cells = np.take(CELLS, i, axis=0, out=kept("cells", *i.shape, CELLS.shape[1], kind=CELLS.dtype), mode="clip")
            for part, rows in parts.items():
                _add_by_class(sums[part][0], cells, rows)
                sums[part][1] += _added(rows)
        return -float(np.log(p * n + TINY).sum())


def _add_by_class(sums: np.ndarray, cells: np.ndarray, rows: np.ndarray) -> None:
    """Adds each input's row to that of its class; two numbers are added at a time, as one complex."""
    pair = np.result_type(rows, np.complex64)
    np.add.at(sums.view(pair).ravel(), cells.ravel(), rows.view(pair).ravel())


def flat_weights(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as parts of one array."""
    cuts = np.cumsum([math.prod(s) for s in SHAPES.values()])[:-1]
    return {k: part.reshape(SHAPES[k]) for k, part in zip(SHAPES, np.split(flat, cuts))}


def fit(model: Model, windows: np.ndarray, steps: int, rate: float, seed: int) -> Model:
    """Adam steps over shuffled windows, as many passes as the steps need."""
    rng = np.random.default_rng(seed)
    w = flat_weights(model.w)
    m, s, step = np.zeros_like(w), np.zeros_like(w), np.empty_like(w)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * STEP_WINDOWS // len(windows)))])
    for t in range(1, steps + 1):
        take = order[(t - 1) * STEP_WINDOWS : t * STEP_WINDOWS]
        g = flat_weights(Model(shaped(w), model.kept).gradients(*targets_of(windows[take]))[1])
        m *= 0.9
        m += np.multiply(g, 0.1, out=step)
        s *= 0.98
        s += np.multiply(np.multiply(g, g, out=g), 0.02, out=g)
        np.sqrt(np.divide(s, 1 - 0.98**t, out=step), out=step)
        step += 1e-8
        w -= np.multiply(np.divide(m, step, out=step), rate / (1 - 0.9**t), out=step)
    return Model(shaped(w), model.kept)


# -- training


def placed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of texts one after the other with begin marks between; starts of all windows, their numbers in the text,
    and the place of every class."""
    n = np.array([len(s) for s in seqs], np.int64)
    per = -(-n // STRIDE)
    total = int(n.sum())
    of = np.full(int((per + 2).sum()) * STRIDE + 1, BEGIN, np.int16)
    first = (np.cumsum(per + 2) - (per + 2)) * STRIDE  # CONTEXT begin marks and one more stand before each sequence
    at = np.repeat(first + CONTEXT + 1 - (np.cumsum(n) - n), n) + np.arange(total)
    of[at] = np.concatenate(seqs)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return of, np.repeat(first, per) + number * STRIDE, number, at


def training_windows(texts: list[bytes], turn: int, rounds: int) -> np.ndarray:
    """WINDOW + 1 classes each: the windows of a turn; every window of a text belongs to one of the rounds."""
    seqs = [np.frombuffer(t, np.int16) for t in texts]
    of, starts, number, _ = placed(seqs)
    shift = np.repeat([zlib.crc32(t) % rounds for t in texts], [-(-len(s) // STRIDE) for s in seqs])
    return of[starts[(number + shift) % rounds == turn, None] + np.arange(WINDOW + 1)]


def targets_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input classes and targets of windows; what stands after a text is no target."""
    windows = windows.astype(np.int64)
    y = windows[:, CONTEXT + 1 :]
    return windows[:, :-1], np.where(y == BEGIN, -1, y)


def train(texts: DataFrame, classes: Classes, rounds: int = ROUNDS) -> Model:
    """Weights after rounds of steps in all partitions of the texts (classes, packed), averaged after each."""
    spark = texts.sparkSession
    model = Model.start(classes.mass)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model.w)
        rate = RATE * (1 - turn / rounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            one_thread()
            model, held = Model(shared.value), []
            steps = seen = 0

            def learn(windows: np.ndarray, least: int) -> None:
                nonlocal model, steps, seen
                n = max(least, -(-len(windows) // STEP_WINDOWS))
                model, steps, seen = fit(model, windows, n, rate, turn), steps + n, seen + len(windows)

            size = 0
            for batch in small_batches(batches, 0, BATCH_BYTES):
                held.append(training_windows(batch.column(0).to_pylist(), turn, rounds))
                size += len(held[-1])
                if size >= STEPS * STEP_WINDOWS:  # memory of a task is bounded
                    learn(np.concatenate(held), MIN_STEPS)
                    held, size = [], 0
            if size:
                learn(np.concatenate(held), 0 if steps else MIN_STEPS)
            if steps:
                yield pa.record_batch([pa.array([seen], pa.int64()), pa.array([seen * flat_weights(model.w).astype(float)])], ["n", "weights"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for batch in batches:
                for k, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                    n, total = n + k, total + row.values.to_numpy()
            if n:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total])], ["n", "weights"])

        schema = "n bigint, weights array<double>"
        sums = stored(texts.mapInArrow(run, schema), "weights").mapInArrow(add, schema)
        n, total = 0, np.zeros(sum(math.prod(s) for s in SHAPES.values()))
        for row in sums.toLocalIterator():
            n, total = n + row["n"], total + np.array(row["weights"])
        if n == 0:
            return model
        model = Model(shaped((total / n).astype(np.float32)))
    return model


# -- scores


def sequences(words: pa.Array, code: np.ndarray, n: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts of n words each, given as numbers of different words, an end after each text; how many each text has."""
    flat, length = flat_ids(words, path)
    flat, length = np.append(flat, END_ID), np.append(length, 1)
    begin = np.cumsum(length) - length
    units = np.insert(code, np.cumsum(n), len(words))
    length = length[units]
    ends = np.cumsum(length)
    at = np.repeat(begin[units] - (ends - length), length) + np.arange(int(ends[-1]) if len(units) else 0)
    return flat[at], np.diff(ends[np.cumsum(n) + np.arange(len(n))], prepend=0)


def score_classes(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural logarithm of the probability of each sequence of classes."""
    if not len(seqs):
        return np.empty(0)
    of, starts, _, at = placed(seqs)
    out = np.empty(len(of), np.float32)
    offsets = np.arange(WINDOW + 1)
    for a in range(0, len(starts), CHUNK):
        places = starts[a : a + CHUNK, None] + offsets
        rows = of[places].astype(np.int64)
        # places after a sequence's end get a score, too, which nothing reads
        out[places[:, CONTEXT + 1 :]] = model.log_probabilities(rows[:, :-1], np.minimum(rows[:, CONTEXT + 1 :], BEGIN - 1))
    return np.bincount(np.repeat(np.arange(len(seqs)), [len(s) for s in seqs]), weights=out[at], minlength=len(seqs))


def shares(ids: np.ndarray, n: np.ndarray, classes: Classes) -> np.ndarray:
    """Sum of the logarithms of the shares that the ids of each sequence have of their classes."""
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=classes.share[ids], minlength=len(n))


def score_ids(seqs: list[np.ndarray], model: Model, classes: Classes) -> np.ndarray:
    """Natural logarithm of the probability of each sequence of ids."""
    if not len(seqs):
        return np.empty(0)
    return score_classes([classes.of[s] for s in seqs], model) + shares(np.concatenate(seqs), np.array([len(s) for s in seqs]), classes)


# -- all of it


def scores(docs: DataFrame, held_out: Column, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    training = in_training(held_out)
    counts = stored(word_counts(docs, training), "word-counts")
    sums = counts.agg(F.sum("n"), F.sum("n_all"), F.count(F.when(F.col("n") > 0, 1))).first()
    n_texts = docs.where(training).count()
    total, every, distinct = (sums[0] or 0) + n_texts, sums[1] or 0, sums[2] + (n_texts > 0)
    hot_rows = counts.where(F.col("n_all") * HOT_WORDS >= every).collect()  # at most HOT_WORDS rows
    names = [r["word"].encode() for r in hot_rows]
    classes = Classes(id_counts(counts, path) | {END_ID: n_texts}, word_starts(path))
    shared = spark.sparkContext.broadcast((names, [r["n"] for r in hot_rows], classes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hot_n, classes = shared.value
        hot_log = np.log10(np.array(hot_n, float) + 1)
        hot_known = np.array(hot_n, np.int64) > 0
        hot = pa.array(names, pa.large_binary())
        for batch in small_batches(batches, 1, WORDS_BYTES):
            words, n = split_words(batch.column(1))
            coded = words.dictionary_encode()
            listed, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            ids, n_ids = sequences(listed, code, n, path)
            ends = pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(n_ids)]).astype(np.int32))
            # words by document: frequent ones have their counts here
            doc = np.repeat(np.arange(len(n)), n)
            where = pc.fill_null(pc.index_in(listed, hot), -1).to_numpy()[code].astype(np.int64)
            is_hot = where >= 0
            log = np.bincount(doc[is_hot], weights=hot_log[where[is_hot]], minlength=len(n)).astype(float)  # of nothing: whole numbers
            known_n = np.bincount(doc[is_hot], weights=hot_known[where[is_hot]], minlength=len(n)).astype(np.int64)
            pair, times = np.unique(doc[~is_hot] * max(len(listed), 1) + code[~is_hot], return_counts=True)
            bounds = np.searchsorted(pair // max(len(listed), 1), np.arange(len(n) + 1)).astype(np.int32)
            rest = listed.take(pa.array(pair % max(len(listed), 1))).cast(pa.large_string()).cast(pa.string())
            yield pa.record_batch([
                batch.column(0), batch.column(2), pa.array(n + 1), pa.array(known_n), pa.array(log),
                pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(classes.of[ids])]), pa.array(shares(ids, n_ids, classes)),
                pa.ListArray.from_arrays(pa.array(bounds), rest), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int64))),
            ], ["doc_id", "held_out", "n_tokens", "hot_known", "hot_log", "classes", "share", "words", "times"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, hot_known bigint, hot_log double, classes binary, share double, words array<string>, times array<bigint>"
    rows = docs.select("doc_id", "text", (~training).alias("held_out")).mapInArrow(run, schema)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = spark.sparkContext.broadcast(train(rows.where("NOT held_out").select("classes"), classes).w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        model = Model(weights.value)
        for batch in small_batches(batches, 1, BATCH_BYTES):
            total = score_classes([np.frombuffer(t, np.int16) for t in batch.column(1).to_pylist()], model) + batch.column(2).to_numpy()
            yield pa.record_batch([batch.column(0), pa.array(np.round(total / math.log(10), DIGITS)), *batch.columns[3:]], ["row", "score", *kept])

    kept = ["doc_id", "held_out", "n_tokens", "hot_known", "hot_log"]
    kinds = f"row bigint, score double, doc_id {kind}, held_out boolean, n_tokens bigint, hot_known bigint, hot_log double"
    scored = stored(rows.select("row", "classes", "share", *kept).mapInArrow(score, kinds), "scored")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    found = rest.join(counts.where("n > 0").select("word", "n"), "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("log"))
    end_log = math.log10(n_texts + 1)
    each = math.log10(total + distinct + 1)
    zero = F.lit(0).cast("bigint")
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", zero) + int(n_texts > 0)).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("log", F.lit(0.0)) + end_log - F.col("n_tokens") * each).alias("base_score"), "score",
    )
