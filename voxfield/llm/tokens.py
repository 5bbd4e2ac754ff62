"""Byte-level BPE ids of many texts, with each distinct chunk of a batch encoded once.

Pre-tokens never reach over a space that stands alone between two other characters, so such texts are cut at their
spaces. The distinct chunks of a batch are encoded together; their ids are told apart by the tokens that begin with a
space, and gathered for every text. Texts with runs of white space or characters beyond the plain set go to the
tokenizer whole. Both ways give the ids of the vocabulary file.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

VOCABULARY = "byte_bpe_50k.json"
_plain = re.compile("[!-~\\n À-ÖØ-öø-ſ]+").fullmatch
_runs = ("  ", " \n", "\n ")


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Little-endian 32-bit ids of texts; ``path`` is a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocabulary = json.loads(self.whole.to_str())["model"]["vocab"]
        specials = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        letter = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(letter[c] for c in token): n for token, n in vocabulary.items() if token not in specials}
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.begins[[n for token, n in ranks.items() if token[:1] == b" "]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (the total last); null counts as empty."""
        listed = texts.to_pylist()
        plain = np.array([_is_plain(t) for t in listed], dtype=bool)
        flat, sizes = np.zeros(0, dtype=np.uint32), np.zeros(len(listed), dtype=np.int64)
        if plain.any():
            flat, sizes[plain] = self._plain_ids(texts.filter(pa.array(plain)))
        if not plain.all():
            bounds, parts, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
            for k in np.flatnonzero(~plain):
                ids = self.whole.encode(listed[k] or "", add_special_tokens=False).ids
                parts += [flat[at:bounds[k]], np.array(ids, dtype=np.uint32)]
                at, sizes[k] = bounds[k], len(ids)
            flat = np.concatenate([*parts, flat[at:]])
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a single leading space is fine for the quick way, too."""
        # a chunk after a space has the ids of the same chunk in the middle of a text, and "." there is one token
        led = [t[:1] == " " and t[1:2] not in ("", " ", "\n") for t in texts]
        _, bounds = self.encode(pa.array(["." + t if lead else t for t, lead in zip(texts, led)], pa.string()))
        return (np.diff(bounds) - np.array(led, dtype=np.int64)).tolist()

    def _plain_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.split_pattern(texts, " ")
        heads = chunks.offsets.to_numpy()[:-1] - chunks.offsets[0].as_py()
        counts = pc.list_value_length(chunks).to_numpy()
        coded = chunks.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(" " + joined), dtype=np.uint32)
        begins = np.flatnonzero(self.begins[ids])
        if len(begins) != len(distinct):
            raise AssertionError("a chunk does not begin with one token that holds its space")
        first = [self.fast.encode_ordinary(t) for t in distinct.take(pa.array(place[heads])).to_pylist()]  # no space before these
        ids = np.concatenate([ids, np.array([i for f in first for i in f], dtype=np.uint32)])
        starts = np.concatenate([begins, len(ids) - sum(map(len, first)) + np.cumsum([0, *map(len, first)])])
        sizes = np.diff(starts)
        place[heads] = len(distinct) + np.arange(len(heads))
        lengths = sizes[place]
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1]) + np.repeat(starts[place] - (ends - lengths), lengths)
        return ids[source], np.add.reduceat(lengths, np.concatenate([[0], np.cumsum(counts)[:-1]]))


def _is_plain(text: str | None) -> bool:
    return bool(text) and text[0] != " " and text[-1] != " " and bool(_plain(text)) \
        and not any(r in text for r in _runs)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a file; the public vocabulary when no path is given."""
    cache = worker_cache()
    key = "encoder", path
    if key not in cache:
        cache[key] = Encoder(path or public_path(VOCABULARY))
    return cache[key]
