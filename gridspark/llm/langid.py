"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it.  A text is
parsed greedily into the longest phrases that the automaton knows; the language whose automaton
needs the fewest phrases for each character wins.

The automata are fitted on a bounded sample: at most ``SAMPLE_DOCS`` documents for each language, the
first by a hash of their ids, and ``SAMPLE_CHARS`` characters of those.  Everything else reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
SAMPLE_CHARS = 16_000
#: Texts are parsed in segments of this length, side by side; phrases go on across them.
SEGMENT = 512
UNDETERMINED = "und"
_SPACES = re.compile(r"\s+")
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def folded(text: str) -> str:
    return _SPACES.sub(" ", text.lower())


def automaton(text: str, alphabet: dict[str, int]) -> np.ndarray:
    """The transitions of the suffix automaton of ``text``: [state, character] -> state, 0 for none.

    State 0 is the start, which no transition enters.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in map(alphabet.__getitem__, text):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out = np.zeros((len(step), len(alphabet) + 1), np.int32)
    for state, edges in enumerate(step):
        for c, to in edges.items():
            out[state, c] = to
    return out


class Model:
    """The automata of all languages in one table of moves.

    ``moves[state * width + character]`` is twice the next row, plus one if the character begins a phrase.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set().union(*samples.values())))}
        self.width = len(self.alphabet) + 1
        self.codes = np.zeros(max(map(ord, self.alphabet), default=0) + 2, np.int64)
        for c, i in self.alphabet.items():
            self.codes[ord(c)] = i
        parts, self.roots, offset = [], [], 0
        for language in self.languages:
            table = automaton(samples[language], self.alphabet).astype(np.int64)
            unknown = table == 0
            to = np.where(unknown, table[0][None, :], table) + offset  # a character that the language lacks is a phrase of its own and leads to the start
            begins = unknown
            begins[0] = True
            parts.append((to * self.width * 2 + begins).ravel().astype(np.int32))
            self.roots.append(offset * self.width)
            offset += len(table)
        self.moves = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language] -> phrases, over whole texts.

        Every segment is first parsed as if a phrase began with it.  Then each is parsed again from the state in which the one before it
        ends, until both parses are in the same state, from where on they are the same.  Where they never are, the segment ends in
        another state, and the next one is parsed again in its turn.
        """
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = self.codes[np.minimum(points, len(self.codes) - 1)]
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + within * SEGMENT
        size = np.minimum(lengths[owner] - within * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        last = np.append(within[1:] == 0, True)[: len(order)]
        before = np.where(within > 0, np.roll(place, 1), -1)[order]
        behind = np.where(last, -1, np.roll(place, -1))[order]
        owner, start, size = owner[order], start[order], size[order]
        live = len(owner) - np.searchsorted(size[::-1], np.arange(SEGMENT), side="right")  # segments longer than k
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        padded = np.append(chars, np.zeros(SEGMENT, np.int64))
        states, counts = np.zeros((2, SEGMENT, len(owner)), np.int32)
        for j, root in enumerate(self.roots):
            state = np.full(len(owner), root, np.int64)
            count = np.zeros(len(owner), np.int64)
            for k in range(SEGMENT):
                n = live[k]
                if not n:
                    break
                move = self.moves[state[:n] + padded[start[:n] + k]]
                count[:n] += move & 1
                state[:n] = move >> 1
                states[k, :n], counts[k, :n] = state[:n], count[:n]
            found, ends = count.copy(), state.copy()
            todo = np.flatnonzero(before >= 0)
            while len(todo):
                at, now, seen = todo, ends[before[todo]], np.zeros(len(todo), np.int64)
                changed = []
                for k in range(SEGMENT + 1):
                    over = size[at] <= k
                    if over.any():  # both parses differ to the end
                        gone = at[over]
                        found[gone] = seen[over]
                        changed.append(gone[ends[gone] != now[over]])
                        ends[gone] = now[over]
                        at, now, seen = at[~over], now[~over], seen[~over]
                    if not len(at):
                        break
                    move = self.moves[now + padded[start[at] + k]]
                    now, seen = (move >> 1).astype(np.int64), seen + (move & 1)
                    same = now == states[k, at]
                    if same.any():
                        met = at[same]
                        found[met] = count[met] - counts[k, met] + seen[same]
                        changed.append(met[ends[met] != state[met]])
                        ends[met] = state[met]
                        at, now, seen = at[~same], now[~same], seen[~same]
                todo = behind[np.concatenate(changed)] if changed else todo[:0]
                todo = todo[todo >= 0]
            out[:, j] = np.bincount(owner, weights=found, minlength=len(texts))
        return out


def samples(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, where) -> dict[str, str]:
    """The training text of each language; bounded by ``SAMPLE_DOCS`` and ``SAMPLE_CHARS`` for each."""
    known = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    slim = known.select(F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash"), F.col(id_col).alias("_id"))
    chosen = slim.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_DOCS).select("_lang", "_hash").distinct()
    ids = [r["_hash"] for r in chosen.collect()]
    rows = known.where(F.xxhash64(F.col(id_col).cast("string")).isin(ids)).select(F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("_text"))
    # An id may have any number of rows.
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_text"))).where(F.col("_n") <= SAMPLE_DOCS)
    texts: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["_lang"], r["_hash"], r["_text"])):
        if len(texts.get(r["_lang"], "")) < SAMPLE_CHARS and has_letter(r["_text"]):
            texts[r["_lang"]] = (texts.get(r["_lang"], "") + " " + folded(r["_text"]))[:SAMPLE_CHARS]
    return texts


def identify(docs: DataFrame, *, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row of ``docs``.

    ``train`` is a condition that picks the rows with labelled text to learn from; its language column
    is no input of a prediction.  A null text, one without a letter, and any text if nothing could be learned, give
    ``und`` with score 0.  Otherwise the score is one less the ratio of the winner's phrases to the runner-up's, raised into
    0 to 1; a tie goes to the first language by name.  Rows with equal ids give a row each; an empty table none.  A text is parsed whole,
    however long; columns other than these three are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(samples(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, where=train)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = 0
            while first < len(texts):
                held, size = [], 0
                while first + len(held) < len(texts) and (not held or size < 1 << 20):
                    held.append(texts[first + len(held)])
                    size += len(held[-1] or "")
                best, score = np.full(len(held), len(m.languages)), np.zeros(len(held))
                at = np.array([i for i, t in enumerate(held) if t and has_letter(t)], int)
                if len(at) and m.languages:
                    found = m.phrases([folded(held[i]) for i in at])
                    best[at] = found.argmin(1)
                    two = np.sort(found, 1)[:, :2] if found.shape[1] > 1 else np.concatenate((found, 2 * found), 1)
                    score[at] = np.clip(1 - two[:, 0] / two[:, 1], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                first += len(held)

    return rows.mapInArrow(run, f"doc_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double")
