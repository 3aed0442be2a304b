"""Which of many topics occur inside which texts, in one pass over each text.

The topics of a course become automata (Aho-Corasick): a state per prefix of a topic, a failure state for its longest suffix
that is a prefix too, and an output link to the next suffix that is a whole topic. Failures are folded
into a full table of moves, so a character costs one look-up whatever the number of topics. An automaton is bounded in cells; more topics make more automata.

A batch of texts is laid end to end with separators, cut into lanes that overlap by the longest topic, and all lanes step
together in numpy, so long texts cost no more than short ones.

Topics travel to the texts once when a check of rows and bytes allows it. Otherwise both are grouped by course and hash: topics in splits
of bounded size, texts in blocks, each split meeting each block of its course. Tasks cut batches by the bytes of their texts, as numpy
holds a character in many bytes while it works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import fits, small_batches

MAX_CELLS = 1 << 24
LANE = 512
SPLIT_TOPICS = 20_000
BLOCK_TEXTS = 20_000


class Automaton:
    """Moves, outputs and output links of a list of distinct, non-empty topics."""

    def __init__(self, topics: list[str]):
        self.topics = topics
        self.alphabet = np.unique(_codes("".join(topics)))
        own = {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}  # 0 is every other character
        children: list[dict[int, int]] = [{}]
        word, depth = [-1], [0]
        for k, topic in enumerate(topics):
            at = 0
            for c in topic:
                step = children[at].get(own[c])
                if step is None:
                    step = children[at][own[c]] = len(children)
                    children.append({})
                    word.append(-1)
                    depth.append(depth[at] + 1)
                at = step
            word[at] = k
        n, width = len(children), len(self.alphabet) + 1
        self.moves = np.zeros((n, width), np.int32)
        self.word, self.fail, self.link = np.array(word, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for state in np.argsort(np.array(depth), kind="stable").tolist():  # shorter prefixes first: failures are done already
            fail = self.fail[state]
            if state:
                self.moves[state] = self.moves[fail]
                self.link[state] = fail if self.word[fail] >= 0 else self.link[fail]
            for c, child in children[state].items():
                self.fail[child] = self.moves[state, c] if state else 0
                self.moves[state, c] = child
        self.ends = (self.word >= 0) | (self.link > 0)
        self.longest = max(depth)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the last character and number of the topic of every occurrence; one may come twice."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        signs = np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int32)
        lanes = -(-len(signs) // LANE)
        before = self.longest - 1
        padded = np.zeros(before + lanes * LANE, np.int32)
        padded[before : before + len(signs)] = signs
        starts = np.arange(lanes) * LANE
        state = np.zeros(lanes, np.int32)
        places, states = [], []
        for t in range(before + LANE):
            state = self.moves[state, padded[starts + t]]
            ended = np.flatnonzero(self.ends[state])
            if len(ended):
                places.append(starts[ended] + (t - before))
                states.append(state[ended])
        place, found = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, states))
        out_place, out_topic = [], []
        while len(found):
            own = self.word[found] >= 0
            out_place.append(place[own])
            out_topic.append(self.word[found[own]])
            place, found = place[self.link[found] > 0], self.link[found][self.link[found] > 0]
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_place, out_topic))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def automata(topics: list[str], max_cells: int = MAX_CELLS) -> list[Automaton]:
    """Automata of bounded tables for all non-empty topics; a topic that alone is over the bound has its own."""
    out, part, states, letters = [], [], 1, set()
    for topic in sorted(set(topics) - {""}):
        if part and (states + len(topic)) * (len(letters | set(topic)) + 1) > max_cells:
            out.append(Automaton(part))
            part, states, letters = [], 1, set()
        part.append(topic)
        states += len(topic)
        letters |= set(topic)
    return out + ([Automaton(part)] if part else [])


def find(texts: list[str], machines: list[Automaton]) -> Iterator[tuple[int, str]]:
    """(number of the text, topic) of every topic inside every text, once."""
    codes = _codes("\0".join(texts) + "\0")
    ends = np.cumsum([len(t) + 1 for t in texts])
    for m in machines:
        # a topic that holds the separator itself could cross texts, so its place decides
        place, topic = m.hits(codes)
        size = np.array([len(t) for t in m.topics])
        text = np.searchsorted(ends, place, side="right")
        inside = text == np.searchsorted(ends, place - size[topic] + 1, side="right") if len(place) else np.empty(0, bool)
        whole = inside & (place < ends[np.minimum(text, len(ends) - 1)] - 1) if len(place) else inside
        for pair in np.unique(text[whole] * len(m.topics) + topic[whole]).tolist():
            yield pair // len(m.topics), m.topics[pair % len(m.topics)]


def _rows(course: list, texts: list, machines: dict, empty: set) -> pa.RecordBatch:
    out: list[tuple] = []
    for c in dict.fromkeys(course):
        mine = [t for x, t in zip(course, texts) if x == c and t is not None]
        if c is None or not mine:
            continue
        if c in empty:
            out += [(c, t, "") for t in mine]
        out += [(c, mine[i], topic) for i, topic in find(mine, machines.get(c, []))]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.record_batch([pa.array(x, pa.string()) for x in columns], ["course", "question", "topic"])


def mentions(topics: DataFrame, texts: DataFrame) -> DataFrame:
    """(course, question, topic): topics (course, topic) that occur inside texts (course, question) of their course.

    Topics and texts are taken as distinct; null ones match nothing, an empty topic is inside every text.
    """
    topics, texts = topics.select("course", "topic").where("topic IS NOT NULL"), texts.select("course", "question")
    schema = "course string, question string, topic string"
    if fits(topics):
        lists: dict[str, list[str]] = {}
        for r in topics.collect():  # of checked size
            lists.setdefault(r["course"], []).append(r["topic"])
        shared = topics.sparkSession.sparkContext.broadcast(lists)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines: dict[str, list[Automaton]] = {}
            empty = {c for c, names in shared.value.items() if "" in names}
            for batch in small_batches(batches):
                course = batch.column(0).to_pylist()
                for c in set(course) & set(shared.value) - set(machines):
                    machines[c] = automata(shared.value[c])
                yield _rows(course, batch.column(1).to_pylist(), machines, empty)

        return texts.mapInArrow(run, schema)
    return _split_mentions(topics, texts, schema)


def _split_mentions(topics: DataFrame, texts: DataFrame, schema: str) -> DataFrame:
    """Every split of a course's topics with every block of its texts."""
    size = topics.groupBy("course").agg(F.ceil(F.count("*") / F.lit(SPLIT_TOPICS)).cast("bigint").alias("splits"))
    blocks = texts.groupBy("course").agg(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)).cast("bigint").alias("blocks"))
    both = size.join(blocks, "course").checkpoint()
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = topics.join(both, "course").withColumn("split", F.pmod(F.xxhash64("topic"), F.col("splits"))).withColumn("block", all_of("blocks"))
    right = texts.join(both, "course").withColumn("block", F.pmod(F.xxhash64("question"), F.col("blocks"))).withColumn("split", all_of("splits"))

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([_rows([], [], {}, set())])
        c, names = a.column("course")[0].as_py(), a.column("topic").to_pylist()
        machines, empty = {c: automata(names)}, {c} if "" in names else set()
        parts = small_batches(b.select(["question"]).to_batches(), 0)
        return pa.Table.from_batches([_rows([c] * x.num_rows, x.column(0).to_pylist(), machines, empty) for x in parts])

    key = ["course", "split", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(match, schema)


def occurrences(topics: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """texts, without the text itself, with each `topic` that occurs inside it, once a row.

    topics: a column `topic`, null ones match nothing, an empty one is inside every text; other columns of texts are carried.
    """
    wanted, keep = topics.select("topic").where("topic IS NOT NULL").distinct(), [c for c in texts.columns if c != text]
    if not fits(wanted):
        both = texts.select(F.lit("").alias("course"), F.col(text).alias("question"))
        found = mentions(wanted.select(F.lit("").alias("course"), "topic"), both.distinct()).select(F.col("question").alias(text), "topic")
        return texts.join(found, text).select(*keep, "topic")
    names = [r["topic"] for r in wanted.collect()]  # of checked size
    shared, at_text = texts.sparkSession.sparkContext.broadcast(names), texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(shared.value)
        every = [""] if "" in shared.value else []
        for batch in small_batches(batches, at_text):
            listed = batch.column(text).to_pylist()
            at = [i for i, t in enumerate(listed) if t is not None]
            pairs = [(at[i], topic) for i, topic in find([listed[i] for i in at], machines)] if at else []
            pairs += [(i, t) for i in at for t in every]
            rows = batch.select(keep).take(pa.array([i for i, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([t for _, t in pairs], pa.string())], [*keep, "topic"])

    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return texts.mapInArrow(run, kinds + "topic string")
