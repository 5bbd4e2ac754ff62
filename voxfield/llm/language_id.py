"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled text. A text is parsed greedily into the longest phrases
that occur in that text; the language whose phrases need the fewest bits (phrases times the logarithm of the reference
length, which makes references of different lengths comparable) wins.

The automata are packed into one sparse table: the step of a state by a symbol stands at the place state + symbol, marked
with its state, and states are numbered so that no two steps meet. A step that is not there leads on from the root and
counts a phrase, so a whole batch of texts is parsed in all languages at once, one symbol of every window a step. A text
is parsed in windows of ``WINDOW`` symbols, each from the root; all of it is parsed.

Symbols are lower-cased letters, every letter of the labelled text its own one, whatever the size of the alphabet; letters
that no labelled text has are one symbol, and a run of other characters is one space. The references are bounded by
``REFERENCE_CHARS`` for a language and ``ALL_CHARS`` together, taken from a sample chosen by a hash of the ids.

Defined results: a null text or one without letters is ``und`` with score 0; without labelled text every text is
``und``; a tie goes to the first language in order; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import received, sample_by_chars, send, slices_of

REFERENCE_CHARS = 16_000
ALL_CHARS = 200_000
#: Symbols of one document that go into a reference at a time.
EXTRACT = 400
WINDOW = 512
BATCH_BYTES = 8 << 20
UNKNOWN = "und"
#: How fast the score rises with the phrases that the winner is ahead.
SHARPNESS = 0.35


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the root."""
    following, link, size, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(following)
        following.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = following[at][symbol]
            if size[at] + 1 == size[to]:
                link[new] = to
            else:
                twin = len(following)
                following.append(dict(following[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and following[at].get(symbol) == to:
                    following[at][symbol] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return following


class Steps:
    """The steps of several automata in one array; a state's number is the place from which its symbols count."""

    def __init__(self, room: int = 1 << 16) -> None:
        self.packed = np.full(room, -1, dtype=np.int64)
        self.numbers: set[int] = set()
        #: Where the search for a state with so many symbols goes on; holes are left to states with fewer.
        self.next: dict[int, int] = {}

    def _grow(self, room: int) -> None:
        if room > len(self.packed):
            self.packed = np.concatenate([self.packed, np.full(max(room, 2 * len(self.packed)) - len(self.packed), -1, np.int64)])

    def place(self, symbols: list[int], room: int) -> int:
        """A number for a state with these symbols (ascending); ``room`` is above every symbol."""
        least = symbols[0] if symbols else 0
        slot = max(self.next.get(len(symbols), 0), least)
        while True:
            number = slot - least
            self._grow(number + room + 1)
            if number not in self.numbers and all(self.packed[number + s] < 0 for s in symbols):
                break
            slot += 1
        self.numbers.add(number)
        for s in symbols:
            self.packed[number + s] = number << 32
        self.next[len(symbols)] = slot
        return number

    def add(self, automaton: list[dict[int, int]], room: int) -> int:
        """Pack an automaton, states of many symbols first; returns the number of its root."""
        order = sorted(range(len(automaton)), key=lambda k: -len(automaton[k]))
        numbers = [0] * len(automaton)
        for k in order:
            numbers[k] = self.place(sorted(automaton[k]), room)
        for k, following in enumerate(automaton):
            for symbol, to in following.items():
                self.packed[numbers[k] + symbol] |= numbers[to]
        return numbers[0]


def letter_table(alphabet: list[str]) -> np.ndarray:
    """Symbol of every code point: 0 for no letter, then the alphabet, then one for all other letters."""
    codes = {c: k + 1 for k, c in enumerate(alphabet)}
    other = len(alphabet) + 1
    table = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = codes.get(low if len(low) == 1 else c, other)
    return table


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray
    #: At state + symbol: the state, times 2 ** 32, plus the next state.
    steps: np.ndarray
    roots: np.ndarray
    symbols: int
    phrase_bits: np.ndarray

    def coded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols in a row, where each text begins, and how many letters it has."""
        sizes = np.array([len(t) if t else 0 for t in texts])
        points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.letters[points]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        keep = codes > 0
        total = np.concatenate([[0], np.cumsum(keep)])
        letters = total[bounds[1:]] - total[bounds[:-1]]
        keep[1:] |= codes[:-1] > 0  # the first of a run of other characters
        keep[bounds[:-1][sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], kept[bounds], letters

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrase counts, and the letters of each text."""
        codes, bounds, letters = self.coded(texts)
        sizes = np.diff(bounds)
        windows = -(-sizes // WINDOW)
        first = np.concatenate([[0], np.cumsum(windows)])
        within = np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)
        laid = np.zeros((int(first[-1]), WINDOW), dtype=np.int32)
        laid.ravel()[np.repeat(first[:-1], sizes) * WINDOW + within] = codes
        lengths = np.minimum(WINDOW, np.repeat(sizes, windows) - WINDOW * (np.arange(first[-1]) - np.repeat(first[:-1], windows)))
        order = np.argsort(-lengths, kind="stable")  # at every step the windows that go on are the first ones
        active = np.searchsorted(-lengths[order], -np.arange(WINDOW), side="left")
        laid = np.ascontiguousarray(laid[order].T)
        count = len(self.languages)
        roots = self.roots[:, None].astype(np.int64)
        state = np.repeat(roots, laid.shape[1], axis=1)
        closed = np.zeros((count, laid.shape[1]), dtype=np.int32)
        for column, n in zip(laid, active.tolist()):
            if not n:
                break
            here, symbol = state[:, :n], column[:n]
            step = self.steps.take(here + symbol)
            lost = np.flatnonzero(step >> 32 != here)
            step &= 0xFFFFFFFF
            if len(lost):  # the phrase ends; the symbol begins the next one, or is one if the reference lacks it
                language, at = np.divmod(lost, n)
                root = self.roots[language]
                again = self.steps.take(root + symbol[at])
                known = again >> 32 == root
                closed[language, at] += (here.ravel()[lost] != root).astype(np.int32) + ~known
                step.ravel()[lost] = np.where(known, again & 0xFFFFFFFF, root)
            state[:, :n] = step
        closed += state != roots
        closed[:, order] = closed.copy()
        out = np.zeros((len(texts), count), dtype=np.int64)
        some = np.flatnonzero(windows)
        if len(some):
            out[some] = np.add.reduceat(closed, first[:-1][some], axis=1).T
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts, letters = self.phrases(texts)
        bits = counts * self.phrase_bits
        best = bits.argmin(axis=1)
        behind = (bits - bits.min(axis=1, keepdims=True)) / self.phrase_bits.mean()
        score = 1 / np.exp(-np.minimum(SHARPNESS * behind, 60)).sum(axis=1)
        named = [self.languages[k] if n else UNKNOWN for k, n in zip(best, letters)]
        return named, np.where(letters > 0, score, 0.0)


def fit(samples: dict[str, list[str]], reference_chars: int = REFERENCE_CHARS) -> Model:
    """Build the automata of labelled texts, at most ``reference_chars`` symbols for a language."""
    samples = {name: own for name, own in samples.items() if any(c.isalpha() for t in own for c in t)}
    languages = sorted(samples)
    seen = sorted({c for own in samples.values() for t in own for c in t.lower() if c.isalpha()})
    counts = {c: 0 for c in seen}
    for own in samples.values():
        for t in own:
            for c in t.lower():
                if c in counts:
                    counts[c] += 1
    alphabet = sorted(seen, key=lambda c: (-counts[c], c))  # frequent letters have near numbers
    model = Model(languages, letter_table(alphabet), np.zeros(0, np.int64), np.zeros(0, np.int64), len(alphabet) + 2, np.zeros(0))
    most = max(1000, min(reference_chars, ALL_CHARS // max(1, len(languages))))
    steps, roots, bits = Steps(), [], []
    for name in languages:
        codes, bounds, _ = model.coded(samples[name])
        parts = sorted(((k, codes[s:min(s + EXTRACT, b)]) for a, b in zip(bounds, bounds[1:])
                        for k, s in enumerate(range(a, b, EXTRACT))), key=lambda x: x[0])  # some of every text first
        text: list[int] = []
        for _, part in parts:
            text += part.tolist()[:most - len(text)]
        roots.append(steps.add(suffix_automaton(text), model.symbols))
        bits.append(np.log2(max(2, len(text))))
    if languages:
        steps._grow(max(steps.numbers) + model.symbols + 1)
        model.steps, model.roots, model.phrase_bits = steps.packed, np.array(roots, dtype=np.int64), np.array(bits)
    return model


def train(docs: DataFrame, reference_chars: int = REFERENCE_CHARS, seed: int = 5) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang) of each language."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    rows = sample_by_chars(known, "lang", "text", "doc_id", 4 * reference_chars, seed).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"])):
        samples.setdefault(str(r["lang"]), []).append(r["text"])
    first = fit(samples, reference_chars)
    if not first.languages:
        return first
    # texts that read as another language (quotations, wrong labels) stay out of the references
    clean = {name: [t for t, got in zip(own, first.predict(own)[0]) if got == name] for name, own in samples.items()}
    return fit({name: clean[name] or own for name, own in samples.items()}, reference_chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    sent = send(docs.sparkSession, model)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = received(sent)
        for batch in batches:
            for part in slices_of(batch, 1, BATCH_BYTES):
                names, scores = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, lang_pred string, score double")
