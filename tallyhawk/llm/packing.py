"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of the rest from the top. Each piece is a
sequence of its own, so no sequence crosses documents and none has padding. A sequence's
number has its length in the leading bits, so those of one length form a bucket; then the
task that made it, then its place there. Nothing is sorted or moved: packing is one pass.

Token ids come from a published vocabulary. Words that white space separates are encoded
alone (neither its normaliser nor its merges look across white space) and remembered in
the worker, which saves encoding a frequent word again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = np.uint32(1).tobytes()
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() takes them for white space, the vocabulary's pattern does not
_LONGEST_KEPT = 64


class WordIds:
    """Token ids of texts as little-endian uint32 bytes; remembers up to ``most`` words, when full the half met first, which has the frequent ones."""

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case letters need no normaliser and no pattern, and a word's last token tells where it ends.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.ends[at] = token.endswith("</w>")
        self.most = most
        self.words: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.nonzero(self.ends[ids])[0] + 1
        if len(cut) != len(stems):  # not expected; each alone is always right
            return self._encode(stems)
        raw = ids.tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Ids of new words: the stem in lower case and the punctuation after it apart, where that is safe, else the word as it is."""
        known = self.words
        plain = [w for w in new if w.isascii() and w.isalpha()]
        lower = list(map(str.lower, plain))
        parts, apart = [], []
        for w in new.difference(plain):
            s = w.rstrip(".,;:!?")
            if s.isalpha() and (s.isascii() or (max(s) < "ɐ" and "İ" not in s)):
                parts.append((w, s.lower(), w[len(s) :]))
            else:
                apart.append(w)
        stems = list({*lower, *[s for _, s, _ in parts]}.difference(known))
        if stems:
            known.update(zip(stems, self._encode_stems(stems), strict=True))
        tails = list({t for _, _, t in parts}.difference(known))
        known.update(zip([*apart, *tails], self._encode(apart + tails), strict=True))
        known.update(zip(plain, map(known.__getitem__, lower), strict=True))
        known.update([(w, known[s] + known[t]) for w, s, t in parts])

    def _forget(self, met: set[str]) -> None:
        for w in met:
            if len(w) > _LONGEST_KEPT:
                self.words.pop(w, None)
                self.words.pop(w.rstrip(".,;:!?").lower(), None)
        if len(self.words) > self.most:
            self.words = dict(islice(self.words.items(), self.most // 2))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [None if text and any(c in text for c in _CONTROLS) else (text or "").split() for text in texts]
        new = set().union(*[words for words in split if words]).difference(self.words)
        if new:
            self._learn(new)
        known = self.words.__getitem__
        out = [self._encode([text])[0] if words is None else b"".join(map(known, words)) for text, words in zip(texts, split, strict=True)]
        if new:
            self._forget(new)
        return out


#: Words that a worker remembers; one of so many takes about 200 MB.
REMEMBERED = 700_000


@lru_cache(maxsize=2)
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens, longest first."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, bit = n // longest * longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


def _cut(path: str, longest: int, remembered: int, most_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, remembered)
        task = TaskContext.get().partitionId() << 32
        # The next number of each length.
        after = {1 << k: (k << 56) + task for k in range(longest.bit_length())}
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 128):
                docs, some = ids[at : at + 128].to_pylist(), texts[at : at + 128].to_pylist()
                for doc, tokens in zip(docs, encode(some), strict=True):
                    tokens += END
                    n = len(tokens) // 4
                    for s, m in cuts(n, longest):
                        rows.append((doc, s, m, tokens[4 * s : 4 * (s + m)], n, after[m], 0))
                        after[m] += 1
                    held += len(tokens)
                if held > most_bytes:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def packed(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", longest: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset``: every token in exactly one piece.

    ``longest`` is a power of two; ``remembered`` bounds a worker's memory of words. Each document ends with id 1; a null text counts as
    empty and so has that one token. Repeated rows give their pieces once each, an empty
    table none. ``offset`` is 0, since a piece fills its sequence. A task that runs again on
    the same rows gives the same numbers; pack a written table, not a plan that draws anew.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_cut(vocabulary, longest, remembered), schema)


def digest(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", longest: int = 2048) -> DataFrame:
    """``packed`` with the ids' CRC-32 in place of the ids."""
    return packed(docs, vocabulary, doc_id, text, longest).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
