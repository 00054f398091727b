"""SentencePiece encoding and decoding by streaming Viterbi over a public piece vocabulary.

A text gets one leading space, and the best segmentation into pieces is the one with the highest sum of log
probabilities; ties go to the longer last piece. The public vocabulary holds merge ranks, not
probabilities, so a piece of rank r gets Zipf's, 1 / ((r + 1) H), in whole millionths of a nat: sums are
exact. A character at which no piece ends is written as its UTF-8 bytes, each with a fixed penalty, so every
text can be encoded and decodes to itself exactly.

Every text is read one character at a time. A boundary stays alive while the characters since are a proper
prefix of some piece, so the window of alive boundaries is shorter than the longest piece. After every
character, as soon as the paths of all alive boundaries run through one boundary, the ids up to it are
committed. What is pending after that determines the state wholly, since only score differences count. So
`Machine` keeps the steps from states with at most `PENDING` pending characters as transitions of an automaton,
built as texts need them, one character each. A word and its space that lead from the state after a space back to it
are walked so the first time, and remembered with their ids. Both have a bound of their own: at `REMEMBER` states these are forgotten, at as
many words the older half is. A task's machine goes with it. Beyond `PENDING` (a long run of one character, say) `Open` steps in place, unremembered,
over a tree of backpointers whose upkeep is constant a character. Both take the same steps; a text that was not
seen before costs more, not other ids.

Nulls: a null text has no ids, as an empty one; a null doc_id stays. Repeated rows are encoded one by one.
A very long text needs memory for its ids, not for a lattice. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PENALTY = -25_000_000
PENDING = 64
REMEMBER = 300_000
WORD = 24
NEVER = -(1 << 62)


def load_vocabulary(path: str = MODEL) -> dict:
    """Pieces with their ids and log probabilities, and the ids of the 256 bytes; read on the driver, a fixed size."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, byte_ids = [], [], [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(sp.id_to_piece(i).replace("▁", " "))
            ids.append(i)
    rank = np.argsort(np.argsort([-sp.get_score(i) for i in ids], kind="stable"), kind="stable")
    harmonic = float((1.0 / np.arange(1, len(ids) + 1)).sum())
    scores = np.rint(-1e6 * np.log((rank + 1.0) * harmonic)).astype(np.int64)
    return {"pieces": pieces, "ids": ids, "scores": scores.tolist(), "bytes": byte_ids}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Pieces:
    """The vocabulary as the stream reads it, and its bytes for decoding."""

    def __init__(self, vocabulary: dict):
        self.score = {p: (s, _packed([i])) for p, s, i in zip(vocabulary["pieces"], vocabulary["scores"], vocabulary["ids"])}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}
        self.longest = max(map(len, self.score))
        self.keep = max(PENDING, self.longest)
        self.byte_ids = vocabulary["bytes"]
        raw = [b""] * (max([*vocabulary["ids"], *self.byte_ids]) + 1)
        for p, i in zip(vocabulary["pieces"], vocabulary["ids"]):
            raw[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.piece_len = np.array([len(x) for x in raw])
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def spelled(self, c: str) -> tuple[int, bytes]:
        """Score and ids of a character's bytes."""
        raw = c.encode()
        return BYTE_PENALTY * len(raw), _packed([self.byte_ids[x] for x in raw])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and offsets; the leading space of each is gone."""
        n = self.piece_len[ids]
        raw = self.piece_bytes[ranges(self.piece_at[ids], n)]
        offs = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        some = np.flatnonzero(np.diff(offs))
        keep = np.ones(len(raw), bool)
        keep[offs[some]] = False
        gone = np.zeros(len(offs), np.int64)
        gone[some + 1] = 1
        return raw[keep], offs - np.cumsum(gone)


class State(dict):
    """A remembered state: character -> (the state after it, ids committed by it).

    pending: the characters since the last commit. alive: (boundary, score, path) of the boundaries that a piece
    may still start from, counted from the last commit; a path is the (length, ids) of each piece up to there.
    """

    __slots__ = ("pending", "alive", "machine")

    def __init__(self, pending: str, alive: list[tuple], machine: Machine):
        self.pending, self.alive, self.machine = pending, alive, machine

    def __missing__(self, c: str) -> tuple[State | Open, bytes]:
        machine, pending = self.machine, self.pending + c
        at = len(pending)
        if at > PENDING:
            return Open(pending, machine), b""
        pieces = machine.pieces
        known, prefixes = pieces.score.get, pieces.prefixes
        top, alive, last = NEVER, [], None
        for one in self.alive:  # the longest piece first, which wins ties
            s = pending[one[0] :]
            own = known(s)
            if own is not None and own[0] + one[1] > top:
                top, last, ids = own[0] + one[1], one, own[1]
            if s in prefixes:
                alive.append(one)
        if last is None:
            last = one
            cost, ids = pieces.spelled(c)
            top = one[1] + cost
        alive.append((at, top, (*last[2], (at - last[0], ids))))
        out, m, k, first = b"", 0, 0, alive[0][2]
        for step in first:
            for one in alive:
                path = one[2]
                if k == len(path) or path[k] != step:
                    break
            else:
                m, out, k = m + step[0], out + step[1], k + 1
                continue
            break
        if k:  # all surviving paths run through this boundary
            pending = pending[m:]
            alive = [(b - m, score, path[k:]) for b, score, path in alive]
        self[c] = step = machine.state(pending, alive), out
        return step

    def rest(self) -> bytes:
        """The ids still pending, if the text ends here."""
        return b"".join(ids for _, ids in self.alive[-1][2])


class Open:
    """A state with too much pending to be remembered: its surviving backpointers form a tree, changed in place.

    up: boundary -> (score, boundary before, ids from there); down: boundary -> boundaries that point to it.
    """

    pending = None

    def __init__(self, pending: str, machine: Machine):
        self.machine, self.at, self.root, self.recent, self.alive = machine, 0, 0, "", [0]
        self.up, self.down = {0: (0, 0, b"")}, {0: ()}
        for c in pending:
            self.push(c)

    def __getitem__(self, c: str) -> tuple[State | Open, bytes]:
        out = self.push(c)
        n = self.at - self.root
        return (self if n > PENDING // 2 else self.machine.resume(self.recent[len(self.recent) - n :])), out

    def push(self, c: str) -> bytes:
        up, down, pieces, root = self.up, self.down, self.machine.pieces, self.root
        at = self.at = self.at + 1
        recent = self.recent = (self.recent + c)[-pieces.keep :]
        top, before, ids = NEVER, at - 1, None
        alive, dead = [], []
        for b in self.alive:
            s = recent[b - at :]
            if s in pieces.score:
                score, own = pieces.score[s]
                if score + up[b][0] > top:
                    top, before, ids = score + up[b][0], b, own
            (alive if s in pieces.prefixes else dead).append(b)
        if ids is None:
            cost, ids = pieces.spelled(c)
            top = up[before][0] + cost
        alive.append(at)
        up[at], down[at] = (top, before, ids), ()
        down[before] += (at,)
        self.alive = alive
        for b in dead:
            while b != root and not down[b] and b not in alive:
                del down[b]
                gone, b = b, up.pop(b)[1]
                down[b] = tuple(x for x in down[b] if x != gone)
        out = b""
        while len(down[root]) == 1 and root not in alive:
            del up[root]
            root = down.pop(root)[0]
            out += up[root][2]
        self.root = root
        return out

    def rest(self) -> bytes:
        out, b = [], self.at
        while b != self.root:
            _, b, ids = self.up[b]
            out.append(ids)
        return b"".join(reversed(out))


class Machine:
    """states: by what is pending. words: the ids that a word and its space commit between two states after a space."""

    def __init__(self, vocabulary: dict):
        self.pieces = Pieces(vocabulary)
        self.states: dict[str, State] = {}
        self.words: dict[str, bytes] = {}
        self.home, self.lead = self.start()[" "]

    @property
    def learnt(self) -> int:
        return len(self.words)

    def state(self, pending: str, alive: list[tuple]) -> State:
        found = self.states.get(pending)
        if found is None:
            if len(self.states) >= REMEMBER:
                self.forget_states()
            found = self.states[pending] = State(pending, alive, self)
        return found

    def start(self) -> State:
        return self.state("", [(0, 0, ())])

    def resume(self, pending: str) -> State | Open:
        """The state with this pending: what is pending determines it."""
        at = self.start()
        for c in pending:
            at, _ = at[c]
        return at

    def forget_states(self) -> None:
        """States point to each other in circles, so they are emptied rather than left to the collector."""
        for s in self.states.values():
            s.clear()
        self.states = {self.home.pending: self.home}

    def forget(self) -> None:
        self.forget_states()
        self.words = {}

    def close(self) -> None:
        """No state and machine point to each other any more, so all memory is free once the machine is let go."""
        self.forget()
        self.states, self.home = {}, None

    def walk(self, at: State | Open, word: str) -> tuple[State | Open, bytes]:
        """Over a word and its space, character by character."""
        begin, every = at, b""
        for c in word:
            at, out = at[c]
            if out:
                every += out
        at, out = at[" "]
        every += out
        if begin is self.home and at is begin and len(word) <= WORD:
            if len(self.words) >= REMEMBER:  # the older half goes
                for old in list(islice(self.words, (REMEMBER + 1) // 2)):
                    del self.words[old]
            self.words[word] = every
        return at, every

    def stream(self, text: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text that comes in characters, as they are committed."""
        at = self.start()
        for c in text:
            at, out = at[c]
            if out:
                yield out
        yield at.rest()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        every: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            *words, last = text.split(" ")
            own = [self.lead, *map(self.words.get, words)]
            at = home = self.home
            for k, word in enumerate(words, 1):
                if own[k] is None or at is not home:
                    at, own[k] = self.walk(at, word)
            for c in last:
                at, out = at[c]
                own.append(out)
            own.append(at.rest())
            every.append(b"".join(own))
            counts[i] = len(every[-1]) // 4
        return np.frombuffer(b"".join(every), "<i4"), counts


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256 (of the ids as little-endian int32), round_trip of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(shared.value)  # a task's own: nothing of it stays in the worker
        gc.disable()  # it would visit every remembered step again and again
        try:
            for batch in batches:
                column = batch.column("text").fill_null("")
                for lo, hi in blocks(column, 1 << 20):
                    part = column.slice(lo, hi - lo)
                    ids, counts = machine.encode(part.to_pylist())
                    offs = np.concatenate([[0], np.cumsum(counts)])
                    buf, at = buffers(part)
                    raw, ends = machine.pieces.decode(ids, counts)
                    same = [np.array_equal(raw[ends[i] : ends[i + 1]], buf[at[i] : at[i + 1]]) for i in range(hi - lo)]
                    data = ids.astype("<i4").tobytes()
                    digest = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
                    arrays = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts), arrays, pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "ids_sha256", "round_trip"])
        finally:
            machine.close()
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            column = batch.column("ids")
            raw, offs = pieces.decode(column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy()))
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")
