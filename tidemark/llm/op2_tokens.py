"""Token counts by a transducer compiled from a tokenizer's vocabulary.

Text is read character by character. The state after a prefix holds what the rest of the text can depend on:
how far the characters read lead into the vocabulary's trie (an Aho-Corasick automaton), and for each
place within that reach from which a piece could still begin, the last token of the text up to there and how
many tokens that text has less than the prefix. A transition finds the one piece that ends at the new character
and may follow the token before it: two tokens may be neighbours if merging their characters, best pair first,
gives these two again, and a sequence of tokens is the tokenizer's own just if all neighbours may be. It emits by
how many tokens the count changes (less than none where a longer piece takes the place of several). So
the automaton is deterministic, and the emissions along any prefix sum to its count.

There are many states, few of which a text meets: they are numbered and their transitions compiled as they are
first needed, from the pieces and their ranks alone, and each Python worker keeps them up to a bound,
beyond which it begins anew, also within a text; this changes no count.

A text is cut into chunks. A chunk's map takes the state in which it is entered to the state in which it is left and
the tokens in between. Where two characters stand side by side in no piece, the state is the first one, however
the chunk was entered: a map is the characters before the first such place, the tokens from there to the last
one, and the state at the chunk's end. Maps compose associatively, in a tree of logarithmic depth, whose
top gives the count; of a long text, 16 chunks at a time from the state in which those before it end. What runs between two such places emit is kept like a transition, by its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, whole_text

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 12
#: Chunks whose maps are composed in one tree; a longer text is taken so many at a time.
TREE = 16
#: So many transitions, and so many runs' emissions, are kept by a Python worker between two trees; one tree adds at most
#: about as many as it has characters.
MOST_KEPT = 400_000
LONGEST_KEPT = 48
LIMIT = 4096
SPACE = "▁"
#: The token before a place that no piece spans.
NONE = -1

_loaded: dict = {}


@dataclass
class Map:
    """What a chunk does to the state in which it is entered.

    head: characters up to the first place that no piece spans, or all. between: the tokens from there to the
    chunk's end; None if there is no such place. state: in which the chunk is left.
    """

    head: str
    between: int | None = None
    state: int = 0


class Transducer:
    """Counts the tokens of texts in a vocabulary of ranked pieces that have SPACE only at their front."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: score by piece, higher ones are merged first. A character that is no piece gives its UTF-8 bytes."""
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a space or a new line doesn't part the pieces of this vocabulary")
        self.rank = pieces
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.pieces = list(pieces)
        number = {p: i for i, p in enumerate(self.pieces)}
        # the trie, its nodes in breadth-first order: children, depth, the node of the longest proper suffix
        self.child: list[dict[str, int]] = [{}]
        self.depth, self.suffix, piece_at = [0], [0], [NONE]
        for p in sorted(pieces, key=len):
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    piece_at.append(NONE)
                node = self.child[node][c]
            piece_at[node] = number[p]
        self.suffix = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            for node in level:
                for c, to in self.child[node].items():
                    self.suffix[to] = self._goto(self.suffix[node], c)
            level = [to for node in level for to in self.child[node].values()]
        #: The pieces that end at a node, with their lengths, and the depths of its suffixes.
        self.ends = [[(self.depth[x], piece_at[x]) for x in self._suffixes(node) if piece_at[x] != NONE] for node in range(len(self.child))]
        self.reach = [sorted(self.depth[x] for x in self._suffixes(node)) for node in range(len(self.child))]
        self.follows: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self._forget()

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        """From a sentencepiece model's pieces and scores."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        return cls({m.id_to_piece(i): m.get_score(i) for i in normal})

    def _goto(self, node: int, c: str) -> int:
        while c not in self.child[node] and node:
            node = self.suffix[node]
        return self.child[node].get(c, 0)

    def _suffixes(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.suffix[node]

    def _forget(self) -> None:
        """Back to the first state alone: at the trie's root, nothing before, no tokens less."""
        first = (0, ((0, NONE, 0),))
        self.states, self.number = [first], {first: 0}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.emits: dict[str, int] = {"\n": 1}

    def _begin_anew(self, state: int) -> int:
        """Forgets all but one state; its new number."""
        key = self.states[state]
        self._forget()
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number

    # ---- compiling ----

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, the best pair of neighbours merged first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.rank[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.rank]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the tokenizer may put piece b behind piece a (NONE: behind anything)."""
        if b not in self.own:
            self.own[b] = self.merged(self.pieces[b]) == [self.pieces[b]]
        if a == NONE or not self.own[b]:
            return self.own[b]
        if (a, b) not in self.follows:
            if len(self.follows) > 4 * MOST_KEPT:
                self.follows.clear()
            self.follows[a, b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return self.follows[a, b]

    def _compiled(self, state: int, c: str) -> tuple[int, int]:
        """The next state and the change of the count."""
        node, places = self.states[state]
        if c not in self.rank:  # bytes, which no piece spans
            step = 0, len(c.encode())
        else:
            to = self._goto(node, c)
            before = {back + 1: (last, less) for back, last, less in places}
            last, less = before[1]
            if last != NONE and self.pieces[last][-1] + c not in self.inside:
                before[1] = NONE, less
            for back, piece in self.ends[to]:
                if back in before and self._may_follow(before[back][0], piece):
                    gain = before[back][1] + 1
                    break
            # places from which a piece could still begin, by how far they lie back
            key = to, ((0, piece, 0), *[(b, before[b][0], before[b][1] - gain) for b in self.reach[to] if b in before])
            number = self.number.setdefault(key, len(self.states))
            if number == len(self.states):
                self.states.append(key)
            step = number, gain
        self.table[state, c] = step
        return step

    # ---- running ----

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """The state after text, entered in a state, and the tokens that are emitted."""
        get, count = self.table.get, 0
        for c in text:
            state, n = get((state, c)) or self._compiled(state, c)
            count += n
        return state, count

    def count(self, runs: list[str]) -> int:
        """The tokens of runs that each begin where no piece spans."""
        emits, found = self.emits, Counter(runs)
        total = 0
        for run, times in found.items():
            n = emits.get(run)
            if n is None:
                n = self.walk(0, run)[1]
                if len(run) <= LONGEST_KEPT:
                    emits[run] = n
            total += n * times
        return total

    def chunk_map(self, chunk: str) -> Map:
        runs = _RUNS.findall(chunk)
        if len(runs) < 2:
            return Map(chunk)
        state, last = self.walk(0, runs[-1])
        return Map(runs[0], self.count(runs[1:-1]) + last, state)

    def compose(self, a: Map, b: Map) -> Map:
        """First a, then b."""
        if a.between is None:
            return Map(a.head + b.head, b.between, b.state)
        state, n = self.walk(a.state, b.head)
        return Map(a.head, a.between + n, state) if b.between is None else Map(a.head, a.between + n + b.between, b.state)

    def total(self, text: str) -> int:
        """The tokens of a whole text, chunk by chunk."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        state = count = 0
        for at in range(0, len(text), TREE * CHUNK):
            if len(self.table) > MOST_KEPT or len(self.emits) > MOST_KEPT:
                state = self._begin_anew(state)  # between two trees: maps hold states' numbers
            part = text[at : at + TREE * CHUNK]
            maps = [self.chunk_map(part[i : i + CHUNK]) for i in range(0, len(part), CHUNK)]
            while len(maps) > 1:  # the upward half of the scan; its last element is the map of the whole part
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            into, n = self.walk(state, maps[0].head)
            state, count = (into, count + n) if maps[0].between is None else (maps[0].state, count + n + maps[0].between)
        return count


#: A run: SPACE characters with what follows up to the next one; a new line is a run by itself.
_RUNS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer.of_model(path)
    return _loaded[path]


def with_token_counts(docs: DataFrame, path: str, column: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    path: a sentencepiece model. Its own begin and end tokens aren't counted, strings such as "<s>" in a
    text are ordinary text. A null text is empty and has 0 tokens; each row is counted by itself, so ties,
    repeated rows and empty tables need nothing special; a row keeps its other columns, whatever they hold. Texts are
    read whole, in time and memory in proportion to their length.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(path)
        for batch in batches:
            yield pa.array([t.total(x or "") for x in batch.to_pylist()], pa.int64())

    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    return docs.withColumn("n_bytes", F.octet_length(whole_text(column)).cast("long")).withColumn("n_tokens", count(whole_text(column))).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_token_counts(documents(spark, sf_dir), public_tokenizers.path(MODEL)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
