"""Token counts by rank-synchronous merging of ragged numpy arrays.

The vocabulary of a byte-fallback BPE model (scores fall with rank, blanks are U+2581) is
read once in each worker.  Texts are cut before every run of blanks and at line feeds, which
no piece crosses (checked when the model is read).  The pre-tokens that a worker has not met
yet are held together as one ragged array; in each round every sequence applies its
lowest-rank pair, at all places that do not overlap, until no pair is left.  A pair whose
result could make a better pair is applied at its leftmost place only, so the outcome is
that of merging one pair at a time.  Runs of blanks are counted in closed form.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import Lookup

BLANK = "▁"
#: Pre-tokens of up to so many characters are remembered, up to so many of them.
CACHED_CHARS, CACHED = 48, 1_000_000
#: Characters of pre-tokens that are merged together.
MERGE_CHARS = 1 << 20
_FAR = np.int32(2**31 - 1)
_CUT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")


class Merger:
    """Counts tokens as the model's library does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        # Runs of blanks, which merge by place among equal scores: tokens of short ones, and the length that longer ones repeat by.
        self.run = max(len(p) for p in score if set(p) == {BLANK})
        self.blanks = [0, 1, *(len(model.encode(" " * n)) for n in range(1, 6 * self.run))]
        if any(self.blanks[n + self.run] != self.blanks[n] + 1 for n in range(1, 5 * self.run)):
            raise ValueError("long runs of blanks do not repeat")
        if any(len(p) > 1 and set(p) == {BLANK} and s > min(score.values()) for p, s in score.items()):
            raise ValueError("runs of blanks must merge last")
        pieces = {p: s for p, s in score.items() if len(p) == 1 or set(p) != {BLANK}}
        if any(BLANK in p[1:] or "\n" in p for p in pieces):
            raise ValueError("a piece crosses the cuts between pre-tokens")
        ranked = sorted(pieces, key=lambda p: -pieces[p])
        ids = {p: i + 1 for i, p in enumerate(ranked)}  # 0: no piece
        self.chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
        # Equal scores would need ties by place; ranks are then shared.
        level, rank = 0, np.zeros(len(ids) + 1, np.int32)
        for k, p in enumerate(ranked):
            level += k > 0 and pieces[p] != pieces[ranked[k - 1]]
            rank[ids[p]] = level
        self.width = len(ids) + 1
        keys, out, risky = [], [], set()
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a and b:
                    keys.append(a * self.width + b)
                    out.append(i)
                    risky.update(x for x in (a, b) if rank[i] <= rank[x])
        self.pairs, self.out = Lookup(np.array(keys, np.int64) + 1), np.array(out, np.int32)
        self.rank = rank
        self.risky = np.zeros(self.width, bool)
        self.risky[list(risky)] = True
        self.known: dict[str, int] = {}
        self.alone: set[str] = set()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, 0 if none."""
        at = self.pairs.find(a.astype(np.int64) * self.width + b + 1)
        return np.where(at >= 0, self.out[at], 0)

    def _blank_tokens(self, n: int) -> int:
        over = max(0, n - len(self.blanks) + self.run) // self.run
        return self.blanks[n - over * self.run] + over

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each pre-token, and whether its first symbol stays a single blank."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        each, back = np.unique(points, return_inverse=True)
        ids = np.array([self.chars.get(int(c), 0) for c in each], np.int32)
        width = np.array([1 if self.chars.get(int(c)) else len(chr(c).encode("utf-8", "surrogatepass")) for c in each], np.int64)
        sym = ids[back] if len(each) else np.zeros(0, np.int32)
        seq = np.repeat(np.arange(len(words)), lengths)
        counts = np.bincount(seq, width[back] if len(each) else None, len(words)).astype(np.int64)
        first = np.zeros(len(words), np.int32)
        some = lengths > 0
        first[some] = sym[(np.cumsum(lengths) - lengths)[some]]
        made = np.zeros(len(sym), np.int32)  # of a symbol with the next one of its sequence
        if len(sym) > 1:
            made[:-1] = np.where(seq[1:] == seq[:-1], self._pair(sym[:-1], sym[1:]), 0)
        while len(sym):
            rank = np.where(made > 0, self.rank[made], _FAR)
            begin = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(rank, begin)
            alive = low < _FAR
            if not alive.all():  # finished sequences leave
                keep = np.repeat(alive, np.diff(np.append(begin, len(seq))))
                sym, seq, made, rank = sym[keep], seq[keep], made[keep], rank[keep]
                low = low[alive]
                if not len(sym):
                    break
                begin = np.flatnonzero(np.diff(seq, prepend=-1))
            size = np.diff(np.append(begin, len(seq)))
            hit = rank == np.repeat(low, size)
            spot = np.flatnonzero(hit)
            # Of places next to each other every second one; only the leftmost one of a risky pair.
            fresh = np.diff(spot, prepend=-2) != 1
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - lead) % 2 == 0]
            leftmost = np.diff(seq[spot], prepend=-1) != 0
            spot = spot[leftmost | ~self.risky[made[spot]]]
            sym[spot] = made[spot]
            heads = np.zeros(len(sym), bool)
            heads[begin] = True
            at_first = spot[heads[spot]]
            first[seq[at_first]] = sym[at_first]
            counts -= np.bincount(seq[spot], minlength=len(counts)) if len(spot) * 8 > len(counts) else 0
            if len(spot) * 8 <= len(counts):
                np.subtract.at(counts, seq[spot], 1)
            keep = np.ones(len(sym), bool)
            keep[spot + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, made = sym[keep], seq[keep], made[keep]
            new = place[spot]
            near = np.zeros(len(sym) + 1, bool)
            near[new] = near[new - 1] = True  # index -1 is past the end
            made[-1] = 0
            t = np.flatnonzero(near[: len(sym) - 1])
            made[t] = np.where(seq[t + 1] == seq[t], self._pair(sym[t], sym[t + 1]), 0)
        return counts, first == self.chars.get(ord(BLANK), -1)

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of these pre-tokens; short ones stay known."""
        long, todo = {}, list(words)
        at = 0
        while at < len(todo):
            end, chars = at, 0
            while end < len(todo) and (chars == 0 or chars + len(todo[end]) <= MERGE_CHARS):
                chars += max(1, len(todo[end]))
                end += 1
            part = todo[at:end]
            counts, alone = self.merge(part)
            for w, c, a in zip(part, counts.tolist(), alone.tolist(), strict=True):
                (self.known if len(w) <= CACHED_CHARS else long)[w] = c
                if a:
                    self.alone.add(w)
            at = end
        return long

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > CACHED:
            self.known, self.alone = {}, set()
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            else:
                cut.append(_CUT.findall(BLANK + t.replace(" ", BLANK)))
        new: set[str] = set()
        runs: dict[str, tuple[int, str]] = {}  # pre-tokens after more than one blank
        for pre in cut:
            new.update(pre)
        for w in [w for w in new if w.startswith(BLANK * 2)]:
            new.discard(w)
            body = w.lstrip(BLANK)
            runs[w] = (len(w) - len(body), BLANK + body)
            new.add(BLANK + body)
        new.discard("\n")
        long = self.learn({w for w in new if w not in self.known})
        value = {"\n": 1} | long
        for w, (blanks, body) in runs.items():
            n = long.get(body)
            n = self.known[body] if n is None else n
            loose = body in self.alone
            value[w] = n - loose + self._blank_tokens(blanks - 1 + loose)
        if value.keys() & self.known.keys():
            value = {k: v for k, v in value.items() if k not in self.known}
        known = self.known
        if len(value) <= 1:
            known.setdefault("\n", 1)
            out = [sum(map(known.__getitem__, pre)) for pre in cut]
        else:
            out = [sum([known[w] if w in known else value[w] for w in pre]) for pre in cut]
        self.alone = {w for w in self.alone if len(w) <= CACHED_CHARS}
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text.

    path: the model's file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            counts: list[int] = []
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= 4 * MERGE_CHARS):
                    chars += len(texts[end]) + 1
                    end += 1
                counts += m.count(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
