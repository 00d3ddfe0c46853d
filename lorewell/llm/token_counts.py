"""Token counts by a compiled finite-state transducer (operator 1).

A byte-fallback BPE vocabulary is compiled, as its states are reached, into a deterministic
transducer over characters. For any text prefix BPE has one encoding, and a sequence of pieces is
that encoding if and only if each pair of neighbours encodes to itself. So the automaton only has
to know, for every cut from which a longer piece may still grow, the text since that cut, the
piece that ends there and by how many tokens the count there differs. Transitions carry the change
of the token count. Chunks of text become state maps (entry state -> exit state, count), which
compose; after a character that no piece crosses, the map of a chunk is constant, so that all
chunks are looked up independently and the scan over a text is a sum. Long texts are cut into
segments that are mapped in parallel, and the maps of a text are composed pairwise in a tree.
"""

from __future__ import annotations

import pickle
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, without

SPACE = "▁"
ROOT = 0
#: Characters from which on a text is cut, and of its segments; places of a segment at which its path is kept.
LONG, SEGMENT = 1 << 16, 1 << 15
PLACES = (*range(1, 65), *range(128, 4097, 64))


class StateMap(NamedTuple):
    """The state map of a segment, in a form that other processes can use: its head, the states (as their
    texts and pieces, with the count so far) of its path from ROOT at PLACES, where the path ends
    and its count. An entry state follows the head until it meets the path."""

    head: str
    path: dict
    end: tuple
    total: int


class Plain(dict):
    """The counts of words that follow a single space; long ones are not kept."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if len(self) >= Transducer.WORDS:
            self.clear()
        n = self.owner.word(SPACE + word)
        if len(word) < 64:
            self[word] = n
        return n


class Transducer:
    """The transducer of one sentencepiece BPE model; states and transitions appear on demand."""

    STATES, WORDS, BLOCK, TRACE = 150_000, 300_000, 4096, 96

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.grows = {p[:n] for p in self.score for n in range(1, len(p))}
        #: True if no piece holds SPACE after another character: then chunks that start with SPACE are apart
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.pairs: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}
        self.plain = Plain(self)
        self.forget()

    def tidy(self) -> None:
        """Empties full caches, between texts."""
        if len(self.states) >= self.STATES:
            self.forget()

    def forget(self) -> None:
        start = (("", None, 0),)
        self.states, self.ids, self.moves = [start], {start: ROOT}, [{}]

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str | None, right: str) -> bool:
        """Whether right, as a piece, can follow left (None: a boundary that nothing crosses)."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(right) == [right] if left is None else self.merged(left + right) == [left, right]
        return known

    def extend(self, state: int, c: str) -> tuple[int, int]:
        """The transition of state by c, made now: (next state, change of the token count)."""
        alive = self.states[state]
        if c not in self.score:
            nxt, weight = (("", None, 0),), len(c.encode())
        else:
            piece, weight = next((s + c, d + 1) for s, last, d in alive if s + c in self.score and self.fits(last, s + c))
            nxt = (*((s + c, last, d - weight) for s, last, d in alive if s + c in self.grows), ("", piece, 0))
        to = self.ids.get(nxt)
        if to is None:
            to = self.ids[nxt] = len(self.states)
            self.states.append(nxt)
            self.moves.append({})
        self.moves[state][c] = move = (to, weight)
        return move

    def run(self, state: int, text: str, trace: list | None = None) -> tuple[int, int]:
        n, moves = 0, self.moves
        for c in text:
            move = moves[state].get(c) or self.extend(state, c)
            state, n = move[0], n + move[1]
            if trace is not None and len(trace) < self.TRACE:
                trace.append((state, n))
        return state, n

    def block_map(self, text: str):
        """The state map of a block as a function: its path from ROOT is kept, and from any other
        entry only the part up to the point where both paths meet is run."""
        trace: list[tuple[int, int]] = []
        end, total = self.run(ROOT, text, trace)

        def of(entry: int) -> tuple[int, int]:
            state, n = entry, 0
            for c, (met, before) in zip(text, trace):
                move = self.moves[state].get(c) or self.extend(state, c)
                state, n = move[0], n + move[1]
                if state == met:
                    return end, n + total - before
            return self.run(entry, text)

        return of

    def named(self, alive: tuple) -> int:
        """The number of a state in this process."""
        if (state := self.ids.get(alive)) is None:
            state = self.ids[alive] = len(self.states)
            self.states.append(alive)
            self.moves.append({})
        return state

    def state_map(self, text: str) -> StateMap:
        path, state, n, at = {}, ROOT, 0, 0
        for place in PLACES:
            if place > len(text):
                break
            state, more = self.run(state, text[at:place])
            n, at = n + more, place
            path[place] = (self.states[state], n)
        end, more = self.run(state, text[at:])
        return StateMap(text[: PLACES[-1]], path, self.states[end], n + more)

    def enter(self, alive: tuple, m: StateMap) -> tuple[tuple, int] | None:
        """(exit state, count) of a map for an entry state; None if its path is not met within the head."""
        state, n, at = self.named(alive), 0, 0
        for place, (met, before) in m.path.items():
            state, more = self.run(state, m.head[at:place])
            n, at = n + more, place
            if self.states[state] == met:
                return m.end, n + m.total - before
        return None

    def compose(self, maps: list[StateMap | None]) -> StateMap | None:
        """The map of neighbouring segments, pair by pair in a tree; None where one is not known."""
        while len(maps) > 1:
            out = []
            for a, b in zip(maps[::2], maps[1::2]):
                met = self.enter(a.end, b) if a and b else None
                out.append(a._replace(end=met[0], total=a.total + met[1]) if met else None)
            maps = out + maps[len(out) * 2 :]
        return maps[0]

    def word(self, chunk: str) -> int:
        """The count that a chunk adds, whatever precedes it."""
        if len(self.words) >= self.WORDS:
            self.words.clear()
        if len(self.states) >= self.STATES:
            self.forget()
        if len(chunk) <= self.BLOCK:
            n = self.run(ROOT, chunk)[1]
        else:
            maps = [self.block_map(chunk[i : i + self.BLOCK]) for i in range(0, len(chunk), self.BLOCK)]
            state, n = ROOT, 0
            for of in maps:
                state, more = of(state)
                n += more
        if len(chunk) < 64:
            self.words[chunk] = n
        return n

    def chunks(self, text: str) -> int:
        """The count of a text with SPACE for spaces that starts with SPACE, as a sum over its chunks."""
        known, total = self.words.get, 0
        for chunk in CHUNKS.findall(text) if self.apart else [text]:
            n = known(chunk)
            total += self.word(chunk) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.apart and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return sum(map(self.plain.__getitem__, text.split(" ")))
        return self.chunks((SPACE + text).replace(" ", SPACE))

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(whether nothing crosses its start, segment) of a text with SPACE for spaces.

        Segments start after a character that no piece crosses if there is one among SEGMENT."""
        out, at, clean = [], 0, True
        while at < len(text):
            end, last = at + SEGMENT, clean
            if end >= len(text):
                end = len(text)
            elif self.apart and (gap := BOUNDARY.search(text, end - 1, end + SEGMENT)):
                end, clean = gap.start() + 1, True
            else:
                clean = False
            out.append((last, text[at:end]))
            at = end
        return out


CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*")
BOUNDARY = re.compile(f"[^{SPACE}](?={SPACE})")
_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of a model file, one for each worker process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _long_counts(texts: DataFrame, model_path: str) -> DataFrame:
    """(key, n) of distinct long texts (key, text); n is null where maps could not be composed."""

    def cut(batches):
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                found = compiled(model_path).segments((SPACE + text).replace(" ", SPACE))
                for i in range(0, len(found), 64):
                    own = found[i : i + 64]
                    nexts = [c for c, _ in found[i + 1 : i + 65]] + [True] * (i + 64 >= len(found))
                    yield pd.DataFrame({"key": key, "k": range(i, i + len(own)), "apart": [c and d for (c, _), d in zip(own, nexts)], "clean": [c for c, _ in own], "part": [p for _, p in own]})

    def mapped(batches):
        for pdf in batches:
            t, out = compiled(model_path), []
            for apart, part in zip(pdf["apart"], pdf["part"]):
                t.tidy()
                out.append((t.chunks(part), None) if apart else (None, pickle.dumps(t.state_map(part))))
            yield pdf[["key", "k", "clean"]].assign(n=pd.array([n for n, _ in out], dtype="Int64"), map=[m for _, m in out])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, t = pdf.sort_values("k"), compiled(model_path)
        t.tidy()
        total, runs = int(pdf["n"].sum()), []
        for clean, m in zip(pdf["clean"], pdf["map"]):
            if m is not None:
                if clean:
                    runs.append([])
                runs[-1].append(pickle.loads(m))
        whole = [t.compose(run) for run in runs]
        n = None if None in whole else total + sum(m.total for m in whole)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "n": pd.array([n], dtype="Int64")})

    parts = texts.mapInPandas(cut, "key string, k long, apart boolean, clean boolean, part string").repartition("key", "k")
    maps = parts.mapInPandas(mapped, "key string, k long, clean boolean, n long, map binary")
    return maps.groupBy("key").applyInPandas(composed, "key string, n long")


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    Counts are those of the sentencepiece library without begin and end tokens. A null text counts
    as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and ids stay as they are, an
    empty table gives an empty table; input columns named like the new ones are replaced. Texts of
    over LONG characters are cut into segments that many tasks map; only these cross a shuffle. The
    few whose maps cannot be composed (whose encoding depends on where it starts over thousands of
    characters) are counted by one task each. Caches of words and states are emptied at fixed sizes."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        t = compiled(model_path)
        return pd.Series([t.count(x) for x in texts], dtype="int64")

    base = without(docs, "n_bytes", "n_tokens", "over_limit")
    text = F.col(f"`{text_col}`")
    key, n = fresh(base, "_key", "_n")
    long = F.coalesce(F.length(text) > LONG, F.lit(False))
    short = base.where(~long).withColumn("n_tokens", counted(text))
    keyed = base.where(long).withColumn(key, F.sha2(text, 256))
    known = _long_counts(keyed.select(F.col(key).alias("key"), text.alias("text")).dropDuplicates(["key"]), model_path).select(F.col("key").alias(key), F.col("n").alias(n))
    rest = keyed.join(known, key, "left").withColumn(n, F.coalesce(n, counted(F.when(F.col(n).isNull(), text))))
    every = short.unionByName(rest.drop(key).withColumnRenamed(n, "n_tokens"))
    return every.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
